"""Language identification as a mixture of languages for each document.

A text is a sequence of words; a word's likelihood under a language is the product over its letters of
the probabilities of the trigrams around them (word ends count as a blank). Expectation-maximisation
finds the shares in which the languages mix to give the document's words. Which languages take part is
chosen by penalised likelihood: a language stays only if the log-likelihood it adds is worth
``penalty * log(words) / 2``; all but one go at once if the best single language passes, else the
languages go one at a time, smallest share first.

Trigram counts come from labelled rows only: a sample by keyed hash of about ``sample`` rows, at any size
of the table, equally many of each language as far as there are so many, hashed into ``BUCKETS`` counts a language. The model is that table, a bounded size.

Prediction reads each text once, whole, in blocks of about a million letters: no shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text where
nothing could be learned; repeated rows are judged each for themselves; equal shares go to the language
that comes first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import sampled

BUCKETS = 1 << 16
BLOCK = 1 << 20
UND = "und"

_alpha: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def blocks(texts: list[str | None], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter, first letter of each word, number of words of each text)."""
    low = [(t or "").lower() for t in texts]
    joined = " " + " ".join(low) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = is_letter()[codes]
    codes[~letter] = 32
    at = np.flatnonzero(letter)
    h = codes[at - 1] * np.uint32(0x9E3779B1) + codes[at] * np.uint32(0x85EBCA77) + codes[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(16)).astype(np.int32)
    first = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum([len(t) + 1 for t in low])
    words = np.diff(np.searchsorted(at[first], ends, side="right"), prepend=0) if len(low) else np.zeros(0, int)
    return bucket, first, words


def learn(labelled: DataFrame, sample: int = 20_000) -> tuple[list[str], np.ndarray]:
    """(languages, log probability by language and bucket) from ``labelled(doc_id, text, lang)``."""
    labelled = labelled.where("lang is not null and text is not null")
    per = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    each = sample // max(1, len(per))
    wanted = F.lit(True)
    for lang, n in sorted(per.items()):
        if n > each:
            wanted = F.when(F.col("lang") == lang, sampled("langid", "doc_id", each, n)).otherwise(wanted)
    labelled = labelled.where(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (t, lang) in enumerate(zip(texts, langs)):
                for a in range(0, len(t), BLOCK):
                    bucket, _, _ = trigrams([t[a : a + BLOCK]])
                    got = np.bincount(bucket, minlength=BUCKETS)
                    sums[lang] = sums[lang] + got if lang in sums else got
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at].astype(np.int64))], ["lang", "bucket", "n"])

    counts = labelled.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # at most BUCKETS rows a language
    langs = sorted(rows["lang"].unique())
    table = np.full((len(langs), BUCKETS), 0.5)
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if langs else table.astype(np.float32)


def _em(p: np.ndarray, words: np.ndarray, starts: np.ndarray, share: np.ndarray, settled: float = 1e-3, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Shares (language, text) by EM until no share of a text moves by ``settled`` in a step (``most`` steps for texts that creep on), and the log-likelihood of each text under them."""
    share = share.copy()
    live, q, w = np.arange(len(words)), p, words
    for _ in range(most):
        s = np.cumsum(w) - w
        joint = q * np.repeat(share[:, live], w, axis=1)
        joint /= joint.sum(axis=0)
        new = np.add.reduceat(joint, s, axis=1) / w
        moves = np.abs(new - share[:, live]).max(axis=0) >= settled
        share[:, live] = new
        if not moves.any():
            break
        if moves.mean() < 0.7:
            q, live, w = q[:, np.repeat(moves, w)], live[moves], w[moves]
    fit = np.log((p * np.repeat(share, words, axis=1)).sum(axis=0, dtype=np.float64))
    return share, np.add.reduceat(fit, starts)


def mixtures(word_ll: np.ndarray, words: np.ndarray, penalty: float = 2.0) -> np.ndarray:
    """Shares (language, text) of the chosen languages; ``words`` are at least 1 for every text."""
    top = word_ll.max(axis=0)
    p = np.exp(np.maximum(word_ll - top, -60.0)).astype(np.float32)
    n_lang = len(p)
    starts = np.concatenate([[0], np.cumsum(words)[:-1]])
    share, full = _em(p, words, starts, np.full((n_lang, len(words)), 1 / n_lang, np.float32))
    cost = penalty * np.log(np.maximum(words, 2)) / 2
    single = np.add.reduceat(np.log(p).astype(np.float64), starts, axis=1)
    best = single.argmax(axis=0)
    alone = single.max(axis=0) >= full - (n_lang - 1) * cost
    chosen = np.zeros_like(share)
    chosen[best[alone], np.flatnonzero(alone)] = 1
    live = np.flatnonzero(~alone)
    share, full, active = share[:, live], full[live], np.ones((n_lang, len(live)), bool)
    while len(live):
        keep = np.repeat(np.isin(np.arange(len(words)), live), words)
        q, w = p[:, keep], words[live]
        s = np.concatenate([[0], np.cumsum(w)[:-1]])
        least = np.where(active, share, np.inf).argmin(axis=0)
        fewer = active.copy()
        fewer[least, np.arange(len(live))] = False
        start = np.where(fewer, np.maximum(share, 1e-3), 0).astype(np.float32)
        tried, fit = _em(q, w, s, start / start.sum(axis=0))
        drop = fit >= full - cost[live]
        chosen[:, live[~drop]] = share[:, ~drop]
        go = drop & (fewer.sum(axis=0) > 1)
        chosen[:, live[drop & ~go]] = tried[:, drop & ~go]
        live, share, full, active = live[go], tried[:, go], fit[go], fewer[:, go]
    return chosen


def shares(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Shares (language, text); all 0 for a text without a letter."""
    out = np.zeros((len(table), len(texts)), np.float32)
    for a, b in blocks(texts):
        bucket, first, words = trigrams(texts[a:b])
        has = np.flatnonzero(words)
        if len(has) and len(table):
            ll = np.stack([np.add.reduceat(row[bucket], first) for row in table])
            out[:, a + has] = mixtures(ll, words[has])
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, shares) of every row of ``docs(doc_id, text)``; shares are written as ``de:0.250,...``."""
    langs, table = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, table))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = sent.value
        for batch in batches:
            got = shares(batch.column(1).to_pylist(), table)
            best = got.argmax(axis=0) if langs else np.zeros(batch.num_rows, int)
            score = got.max(axis=0).astype(float) if langs else np.zeros(batch.num_rows)
            names = [langs[k] if s > 0 else UND for k, s in zip(best, score)]
            mixed = [",".join(f"{langs[k]}:{v:.3f}" for k, v in enumerate(col) if v > 0) for col in got.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(mixed, pa.string())], ["doc_id", "lang_pred", "score", "shares"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, shares string")


def held_out(mod: int, rest: int):
    """Whether a row is kept from learning: the CRC-32 of its doc_id as text leaves that remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def op3_language(docs: DataFrame) -> DataFrame:
    """The contract's row for every document."""
    model = learn(docs.where(~held_out(4, 2)).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "shares")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Rows of ``docs(doc_id, text, lang, ...)`` whose main language has at least the share ``least``; ``lang`` becomes what was predicted.

    Defined results: null texts, texts without a letter, and every row where nothing could be learned go; repeated rows are judged each
    for themselves; at equal shares the language that comes first by code point counts; an empty table stays empty; a null doc_id is a
    row like any other; other columns are carried along, whatever their names.
    """
    cols = docs.columns
    langs, table = learn(docs.where(~held_out(4, 2)).select("doc_id", "text", "lang"))
    sent = docs.sparkSession.sparkContext.broadcast((langs, table))
    at = cols.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = sent.value
        for batch in batches:
            got = shares(batch.column(at).to_pylist(), table)
            if langs:
                ok = got.max(axis=0) >= least
                pred = pa.array([langs[k] for k in got.argmax(axis=0)], pa.string())
                batch = batch.set_column(cols.index("lang"), batch.schema.field("lang").with_type(pa.string()), pred)
                yield batch.filter(pa.array(ok))

    return docs.mapInArrow(choose, docs.schema)
