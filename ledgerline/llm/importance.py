"""Target-distribution importance resampling over hashed n-grams, their checksums derived from running ones.

A document is scanned once: its words, joined by one space, go through CRC-32 from left to right and the running checksum at every
word's end is kept. The checksum of any run of words then follows from two of them: with ``A`` what stands before the run and ``B``
the run, ``crc(AB) = shift(crc(A), |B|) xor crc(B)``, where ``shift`` multiplies by ``x ** (8 * |B|)`` in GF(2)[x] modulo the
polynomial, one table for each bit of the length. No run of words is ever built or hashed by itself.

Each feature falls into the bucket of its checksum. Buckets are counted over all documents and over the whole target; a bucket's
gain is the scaled logarithm of the ratio of both frequencies, a document's weight the sum over its features. Weights with a keyed
Gumbel draw added put the documents in order, and the first ones are a sample without replacement in proportion to the weights.

Between the two passes each document keeps its buckets, two bytes a feature, so texts are read once. Counts are summed in each task
before they are shuffled; the order of all documents is found by ranges.

Defined results: a null text, or one without words, has no features and weight 0; repeated rows count each for themselves and are
drawn each for themselves; a null doc_id draws as the word ``null`` and comes before all ids on ties; with an empty target every count
of it is 0; an empty table has no rows. Only doc_id and text are read, so other columns cannot clash. A text of any length is scanned
whole, in stretches.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise, numbered

# What separates words (ASCII but letters and digits), the polynomial, the scale of gains, the seed of the draw.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
POLYNOMIAL = 0xEDB88320
SCALE = 1000
SEED = "2024"

#: Bytes of text that are scanned together.
STRETCH = 1 << 20


def _letters() -> bytes:
    """Byte by byte: A-Z in lower case, separators as spaces, all else as it is."""
    table = bytearray(range(256))
    for b in SEPARATORS:
        table[b] = 0x20
    for b in range(0x41, 0x5B):
        table[b] = b + 0x20
    return bytes(table)


LETTERS = _letters()


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


BYTE = _byte_table()


def _after_byte(crc: np.ndarray, byte: int) -> np.ndarray:
    """Checksums of texts with one more byte."""
    c = ~crc
    return ~(BYTE[(c ^ np.uint32(byte)) & np.uint32(255)] ^ (c >> np.uint32(8)))


def _times(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & np.uint32(255)] ^ tables[1][(c >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(c >> np.uint32(16)) & np.uint32(255)] ^ tables[3][c >> np.uint32(24)]


def _shifts() -> list[np.ndarray]:
    """For each k, multiplication by x ** (8 * 2 ** k) as four tables, one for each byte of a checksum; squared from the one before."""
    every = np.arange(256, dtype=np.uint32)
    unit = lambda step: np.stack([step(every << np.uint32(8 * j)) for j in range(4)])
    out = [unit(lambda c: BYTE[c & np.uint32(255)] ^ (c >> np.uint32(8)))]
    while len(out) < 40:
        out.append(unit(lambda c, last=out[-1]: _times(last, _times(last, c))))
    return out


SHIFTS = _shifts()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The part of a text's checksum that its beginning (with checksum ``crc``) has left after ``length`` more bytes."""
    out, k = crc.copy(), 0
    while (length >> k).any():
        moved = ((length >> k) & 1).astype(bool)
        out[moved] = _times(SHIFTS[k], out[moved])
        k += 1
    return out


def checksums(words: list[bytes], of: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to ``longest``: (owner, CRC-32) of each run of n words of one owner, joined by one space; ``of`` is the owner of each word."""
    ends = np.fromiter(itertools.accumulate(map(b" ".__add__, words), lambda crc, word: zlib.crc32(word, crc), initial=0), np.uint32, len(words) + 1)
    starts = _after_byte(ends[:-1], 0x20)
    place = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    ends, began = ends[1:], np.concatenate([np.zeros(1, np.int64), place[:-1]]) + 1
    for n in range(1, longest + 1):
        last = slice(n - 1, None)
        first = slice(0, max(0, len(words) - n + 1))
        whole = of[first] == of[last]
        yield of[first][whole], ends[last][whole] ^ shift(starts[first][whole], (place[last] - began[first])[whole])


def _stretches(texts: Iterable[str | None]) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """Words of consecutive texts, and whose they are; texts are put together until they hold ``STRETCH`` bytes."""
    words, of, held, size = [], [], 0, 0
    for text in texts:
        found = (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()
        words += found
        of.append(len(found))
        size += sum(map(len, found))
        held += 1
        if size >= STRETCH:
            yield words, np.array(of), held
            words, of, held, size = [], [], 0, 0
    if held:
        yield words, np.array(of), held


def hashed(docs: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, features) of each row: features are its buckets, as a binary array of ``kind(buckets)``."""
    kind = _kind(buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, features = [], [], []
            for words, sizes, held in _stretches(x.as_py() for x in batch.column(1)):
                found = list(checksums(words, np.repeat(np.arange(held), sizes), longest))
                owner = np.concatenate([o for o, _ in found])
                bucket = (np.concatenate([c for _, c in found]) % np.uint32(buckets)).astype(kind)
                order = np.argsort(owner, kind="stable")
                per = np.bincount(owner, minlength=held)
                n_words += sizes.tolist()
                n_features += per.tolist()
                features += [x.tobytes() for x in np.split(bucket[order], np.cumsum(per)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(features, pa.binary())], ["doc_id", "n_words", "n_features", "features"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_words long, n_features long, features binary")


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def counts(rows: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) over all features of ``hashed`` rows, summed in each task first."""
    kind = _kind(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets) if len(x.as_buffer()) > 4 * buckets else 0
            few = [x.as_buffer() for x in batch.column(0) if len(x.as_buffer()) <= 4 * buckets]
            if few:
                total += np.bincount(np.frombuffer(b"".join(few), kind), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    return rows.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of every bucket, from ``counts`` of the documents and of the target."""
    spark = source.sparkSession
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    over = ((F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return both.join(F.broadcast(totals)).select("bucket", F.floor(SCALE * F.log(over)).cast("long").alias("gain"))


def weights(rows: DataFrame, gain: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of ``hashed`` rows. The gains, one number a bucket, go to every task."""
    kind, of = _kind(buckets), np.zeros(buckets, np.int64)
    for r in gain.collect():  # as many rows as there are buckets, a parameter
        of[r.bucket] = r.gain
    sent = rows.sparkSession.sparkContext.broadcast(of)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(sent.value[np.frombuffer(x.as_buffer(), kind)].sum()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``percent`` of the documents of ``least`` words or more are drawn and ranked, all others have no rank.

    Features are the runs of 1 to ``longest`` words.
    """
    rows = materialise(hashed(docs, longest, buckets))
    gain = gains(counts(rows, buckets), counts(hashed(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets), buckets), buckets)
    scored = weights(rows, gain, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialise(scored.withColumn("score", F.col("weight") + luck))
    ranked = numbered(scored.where(F.col("n_words") >= least).withColumn("g", F.lit(0)), ["g"], [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")])
    rank = F.when(F.col("idx") < F.floor(F.col("n") * percent / 100), F.col("idx") + 1).cast("long")
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, rank.alias("rank")).union(scored.where(F.col("n_words") < least).select(*out, F.lit(None).cast("long")))


def op12_importance(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row for every document: single words, 10,000 buckets, a tenth drawn."""
    return resample(docs, benchmark)


def oracle(buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = SEED) -> str:
    """The same rows for single words in DuckDB SQL: every distinct word hashed byte by byte."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end"
    steps = ", ".join(["c0 as (select i, i::bigint as v from range(256) t(i))"] + [f"c{k + 1} as (select i, {bit} as v from c{k})" for k in range(8)])
    octets = "list_transform(generate_series(1, octet_length(encode(w))), lambda k: ('0x' || substr(hex(encode(w)), 2 * k - 1, 2))::bigint)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda a, x: xor(tab[(xor(a, x) & 255) + 1], a >> 8)), 4294967295)"
    return f"""with {steps}, tab as (select list(v order by i) as tab from c8),
    d as (select row_number() over () as r, doc_id, regexp_extract_all({lower}, '{word}') as ws from documents),
    dw as (select r, unnest(ws) as w from d), bw as (select unnest(regexp_extract_all({lower}, '{word}')) as w from benchmark),
    voc as (select w, {crc} % {buckets} as b from (select w from dw union select w from bw), tab),
    s as (select b, count(*) as s from dw join voc using (w) group by b), t as (select b, count(*) as t from bw join voc using (w) group by b),
    al as (select (select count(*) from dw) as a_s, (select count(*) from bw) as a_t),
    g as (select r.b, floor({SCALE} * ln((coalesce(t, 0) + 1)::double * (a_s + {buckets}) / ((coalesce(s, 0) + 1)::double * (a_t + {buckets}))))::bigint as gain from range({buckets}) r(b) left join s using (b) left join t using (b), al),
    w as (select r, sum(gain)::bigint as weight from dw join voc using (w) join g using (b) group by r),
    e as (select d.r, doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight,
      coalesce(weight, 0) + floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from d left join w using (r)),
    k as (select *, row_number() over (order by score desc, doc_id nulls first, n_features) as p, count(*) over () as n from e where n_features >= {least})
    select doc_id, e.n_features, e.weight, e.score, case when p <= n * {percent} // 100 then p end as rank from e left join (select r, p, n from k) using (r)"""
