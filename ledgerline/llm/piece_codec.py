"""Encoding with merge pieces under seeded merge-dropout, and lossless decoding.

A text gets a blank before it and is cut where no piece can reach across: each run of blanks goes with what
follows it, and a line feed stands alone. Inside such a chunk an agenda holds the candidate merges, best
score first, leftmost first at equal score. A candidate that comes up is skipped for good with probability
``dropout``, decided by a keyed hash of the seed, the document's key, the chunk's number in the text, the place in the chunk and
the merged piece; else its two sides become one piece and the new neighbours go on the agenda. Every occurrence of a
word thus has merges of its own, in one document too. With dropout 0 the result is the vocabulary's own merge
encoding. Letters without a piece become byte pieces, and so does the word mark where it is a letter of the text,
so decoding gives back every text exactly.

The chunks of a block of texts are encoded together, those of one length as the columns of a matrix: in each round every chunk
carries out the first candidate of its agenda, so there are as many rounds as the longest of them has merges. Nothing is remembered from one
block to the next. Chunks of more than ``LONG`` letters have an agenda of their own, a heap, with the same results.

Defined results: null and empty texts have no pieces; rows with equal doc_id and text get the same pieces, a null doc_id
being a key like any other; there is no shuffle, and every text is encoded whole. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import per_worker
from ledgerline.llm.langid import blocks
from ledgerline.llm.vocabulary import SPACE, read_pieces

#: Chunks of more letters are encoded each for itself.
LONG = 63
#: Letters of the texts that are encoded together.
TOGETHER = 1_000_000
_ALL = (1 << 64) - 1
_STEP, _ONE, _TWO = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_NONE = (1 << 31) - 1


def _mixed(x: int) -> int:
    x = (x ^ (x >> 30)) * _ONE & _ALL
    x = (x ^ (x >> 27)) * _TWO & _ALL
    return x ^ (x >> 31)


def _mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ONE)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_TWO)
    return x ^ (x >> np.uint64(31))


class Pairs:
    """Which symbol two neighbouring symbols make: a table with open addressing, looked up for many pairs at once."""

    def __init__(self, made: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(made)).bit_length())
        size = 1 << self.bits
        self.keys, self.made = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        for (a, b), c in made.items():
            key = a << 24 | b
            at = (key * _STEP & _ALL) >> (64 - self.bits)
            while self.keys[at] >= 0:
                at = at + 1 & size - 1
            self.keys[at], self.made[at] = key, c

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbols made, -1 for none."""
        key = a.astype(np.int64) << 24 | b
        at = (key.astype(np.uint64) * np.uint64(_STEP) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == key, self.made[at], np.int32(-1))
        again = np.flatnonzero((got != key) & (got >= 0))
        at = at[again]
        while len(again):
            at = at + 1 & len(self.keys) - 1
            got = self.keys[at]
            same = got == key[again]
            out[again[same]] = self.made[at[same]]
            on = ~same & (got >= 0)
            again, at = again[on], at[on]
        return out


class Codec:
    """Symbols are the pieces, the letters that pieces are made of, and one symbol for any other letter."""

    def __init__(self, pieces: dict[str, tuple[int, float]], octets: dict[int, int], dropout: float = 0.1, seed: int = 1):
        self.key = _mixed(seed * _STEP & _ALL)
        self.limit = int(dropout * (1 << 32))
        order = {v: k for k, v in enumerate(sorted({v for _, v in pieces.values()}, reverse=True))}
        size = 1 + max([i for i, _ in pieces.values()] + list(octets.values()), default=0)
        symbols = {p: i for p, (i, _) in pieces.items()}
        for p in pieces:
            for c in p:
                symbols.setdefault(c, size + len(symbols))
        self.other = 1 + max(symbols.values(), default=size)
        self.size = size
        self.rank = np.full(self.other + 1, _NONE >> 6, np.int32)
        self.bytes: list[bytes] = [b""] * size
        for p, (i, v) in pieces.items():
            self.rank[i] = order[v]
            self.bytes[i] = p.replace(SPACE, " ").encode()
        self.is_piece = np.zeros(self.other + 1, bool)
        self.is_piece[[i for i, _ in pieces.values()]] = True
        self.octets = np.zeros(256, np.int32)
        for b, i in octets.items():
            self.bytes[i], self.octets[b] = bytes([b]), i
        self.letters = np.full(0x110000, self.other, np.int32)
        for p, i in symbols.items():
            if len(p) == 1 and p != SPACE:
                self.letters[ord(p)] = i
        self.letters[32] = symbols.get(SPACE, self.other)
        self.made = {(symbols[p[:k]], symbols[p[k:]]): i for p, (i, _) in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.pairs = Pairs(self.made)

    def occurrence(self, key: int, number: int) -> int:
        """64 bits for the chunk of that number in the text of that key."""
        return _mixed((_mixed((key & _ALL) ^ self.key) + (number + 1) * _STEP) & _ALL)

    def skips(self, occurrence: int, place: int, rank: int) -> bool:
        return _mixed(occurrence ^ ((place << 32 | rank) * _STEP & _ALL)) >> 32 < self.limit

    def cut_one(self, letters: list[int], occurrence: int) -> list[int]:
        """The symbol of each piece of one chunk at the place where it begins, -1 elsewhere; ``letters`` are its symbols.

        The agenda holds ``(rank, place, end of the left piece, end of the right piece)``; an entry counts while both pieces are still there.
        """
        n, s = len(letters), list(letters)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def enter(a: int) -> None:
            if a >= 0 and (b := after[a]) < n and (c := self.made.get((s[a], s[b]))) is not None and not self.skips(occurrence, a, int(self.rank[c])):
                heapq.heappush(agenda, (int(self.rank[c]), a, b, after[b]))

        for a in range(n):
            enter(a)
        while agenda:
            _, a, b, c = heapq.heappop(agenda)
            if s[a] < 0 or after[a] != b or after[b] != c or s[b] < 0:
                continue
            s[a], s[b], after[a] = self.made[s[a], s[b]], -1, c
            if c < n:
                before[c] = a
            enter(a)
            enter(before[a])
        return s

    def cut_equal(self, s: np.ndarray, occurrence: np.ndarray) -> None:
        """The same for many chunks of one length, each a column of ``s``, in place."""
        length, n = s.shape
        agenda, makes = np.full((length, n), _NONE, np.int32), np.full((length, n), -1, np.int32)
        after = np.repeat(np.arange(1, length + 1, dtype=np.int8)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, length - 1, dtype=np.int8)[:, None], n, axis=1)

        def enter(place: np.ndarray | int, at: np.ndarray | slice, left: np.ndarray, right: np.ndarray) -> None:
            made = self.pairs.look_up(left, right)
            rank = self.rank[made].astype(np.int64)
            entry = np.where(made >= 0, rank << 6 | place, _NONE)
            if self.limit:
                some = np.flatnonzero(made >= 0)
                where = place[some].astype(np.uint64) if isinstance(place, np.ndarray) else np.uint64(place)
                drawn = _mixed_all(occurrence[at][some] ^ ((where << np.uint64(32) | rank[some].astype(np.uint64)) * np.uint64(_STEP)))
                entry[some[drawn >> np.uint64(32) < np.uint64(self.limit)]] = _NONE
            agenda[place, at], makes[place, at] = entry, made

        for a in range(length - 1):
            enter(a, slice(None), s[a], s[a + 1])
        while True:
            entry = agenda.min(axis=0)
            at = np.flatnonzero(entry != _NONE)
            if not len(at):
                return
            a = (entry[at] & 63).astype(np.int64)
            b = after[a, at].astype(np.int64)
            c = after[b, at].astype(np.int64)
            made = makes[a, at]
            s[a, at], s[b, at] = made, -1
            agenda[a, at] = agenda[b, at] = _NONE
            after[a, at] = c
            more = np.flatnonzero(c < length)
            if len(more):
                x, y, z = a[more], c[more], at[more]
                before[y, z] = x
                enter(x, z, made[more], s[y, z])
            p = before[a, at].astype(np.int64)
            more = np.flatnonzero(p >= 0)
            if len(more):
                x, z = p[more], at[more]
                enter(x, z, s[x, z], made[more])

    def encode_all(self, texts: list[str | None], keys: list[int]) -> list[bytes]:
        """Piece ids of each text as little-endian 32-bit integers."""
        codes = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        begins = np.concatenate([[0], ends[:-1]])
        blank, line = codes == 32, codes == 10
        starts = line | blank
        starts[1:] &= line[1:] | ~blank[:-1]
        starts[1:] |= line[:-1]
        starts[begins[begins < ends]] = True
        start = np.flatnonzero(starts)
        length = np.diff(start, append=len(codes))
        count = np.searchsorted(start, ends) - np.searchsorted(start, begins)
        s = self.letters[codes]
        with np.errstate(over="ignore"):
            of_text = _mixed_all(np.array([k & _ALL for k in keys], np.uint64) ^ np.uint64(self.key))
            number = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count) + 1
            occurrence = _mixed_all(np.repeat(of_text, count) + number.astype(np.uint64) * np.uint64(_STEP))
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=0))
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                same = order[x:y]
                n = int(length[same[0]])
                if n > LONG:
                    for i in same.tolist():
                        s[start[i] : start[i] + n] = self.cut_one(s[start[i] : start[i] + n].tolist(), int(occurrence[i]))
                elif n > 1:
                    where = start[same][None, :] + np.arange(n)[:, None]
                    matrix = s[where]
                    self.cut_equal(matrix, occurrence[same])
                    s[where] = matrix
        # a letter that is no piece becomes its bytes
        width = (s >= 0).astype(np.int64)
        odd = np.flatnonzero((s >= 0) & ~self.is_piece[s])
        c = codes[odd].astype(np.int64)
        wide = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        width[odd] = wide
        at = np.cumsum(width) - width
        ids = np.zeros(int(width.sum()), "<u4")
        whole = np.flatnonzero(width == 1)
        ids[at[whole]] = s[whole]
        for k in range(1, 5):
            these = np.flatnonzero(wide == k)
            for j in range(k):
                part = c[these] >> 6 * (k - 1 - j)
                octet = part if k == 1 else (0xF00 >> k & 0xFF | part) if j == 0 else 0x80 | part & 0x3F
                ids[at[odd[these]] + j] = self.octets[octet]
        total = np.concatenate([at, [len(ids)]])
        return [ids[total[a] : total[b]].tobytes() for a, b in zip(begins.tolist(), ends.tolist())]

    def encode(self, text: str | None, key: int = 0) -> bytes:
        return self.encode_all([text], [key])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8")[1:]


def _with_codec(docs: DataFrame, make, schema: str, path: str | None, dropout: float, seed: int) -> DataFrame:
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(("codec", path, dropout, seed), lambda: Codec(*vocabulary.value, dropout, seed))
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in blocks(texts, TOGETHER):
                yield make(codec, batch.column(0).slice(a, b - a), texts[a:b], codec.encode_all(texts[a:b], keys[a:b]))

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")


def encode(docs: DataFrame, path: str | None = None, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """(doc_id, ids) of every row of ``docs(doc_id, text)``."""

    def make(codec: Codec, key, texts, raw: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
        values = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
        return pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "ids"])

    return _with_codec(docs, make, "ids array<int>", path, dropout, seed)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of ``encoded(doc_id, ids)``."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(("codec", path, 0.0, 0), lambda: Codec(*vocabulary.value, 0.0, 0))
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def op10_pieces(docs: DataFrame, path: str | None = None, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, lossless) of every document: encoded, decoded again and compared."""

    def make(codec: Codec, key, texts, raw: list[bytes]) -> pa.RecordBatch:
        n = [len(r) // 4 for r in raw]
        digest = [hashlib.sha256(r).hexdigest() for r in raw]
        same = [codec.decode(np.frombuffer(r, "<u4").tolist()) == (t or "") for r, t in zip(raw, texts)]
        return pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(digest), pa.array(same)], ["doc_id", "n_pieces", "ids_sha256", "lossless"])

    return _with_codec(docs, make, "n_pieces long, ids_sha256 string, lossless boolean", path, dropout, seed)
