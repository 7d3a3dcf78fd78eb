"""Repeated passages: unit hashing over the whole corpus, with original offsets.

A text's units are its lines, cut again before each word that begins with a capital and after each sentence end
(so a passage that was set into a line starts and ends units of its own). A unit is normalised (lower case, single
blanks, no marks at its ends) and hashed. Digests are counted over all documents; the occurrence in the smallest
doc_id, and there the first, is kept, any other is a repeat. Repeats that follow each other make a run; units of
fewer than ``short`` words have no digest and neither start nor break a run. A run of at least ``least`` words is a
passage to remove; it is reported by its first and last code point in the original text.

With ``lines``, a line that repeats a whole line is a passage to remove whatever its length: lines are hashed
beside the units, in a space of their own. Passages that overlap are reported as one. The query asks for lines.

Both minimums are parameters: ``short=1, least=1`` removes every later occurrence of every unit. Shuffles carry a digest of 128 bits and offsets for each unit, never texts. A digest that stands in a third of all
documents is one partial sum a task, and the join that marks its occurrences can be split by Spark, since the
other side has one row a digest.

Defined results: null and empty texts have no units; rows that share a doc_id are one document by rank (all of them
keep what it keeps) and cut each for itself; a null doc_id comes last; a passage that comes twice in one document is removed the second
time; a line without a letter or digit is no passage; only documents with something to remove have rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import free_name

SHORT, LEAST = 3, 25
LAST = (1 << 63) - 1
SENTENCE = (".", "!", "?")
CLOSING = "\"')]}»”’*"


def cut_lines(text: str) -> Iterator[list[tuple[int, int]]]:
    """The units of each line that has any, as (start, end): no blanks at their ends."""
    at = 0
    for line in text.split("\n"):
        out: list[tuple[int, int]] = []
        start, end, pos = -1, at, at
        for w in line.split(" "):
            if w:
                first = w if w[0].isalnum() else w.lstrip("\"'([{«“‘¿¡*-")
                if start >= 0 and first and first[0].isupper() and (len(first) == 1 or not first.isupper()):
                    out.append((start, end))
                    start = pos
                elif start < 0:
                    start = pos
                end = pos + len(w)
                if w[-1] in SENTENCE or w[-1] in CLOSING and w.rstrip(CLOSING).endswith(SENTENCE):
                    out.append((start, end))
                    start = -1
            pos += len(w) + 1
        if start >= 0:
            out.append((start, end))
        if out:
            yield out
        at += len(line) + 1


def cut(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each unit: no blanks at its ends."""
    for line in cut_lines(text):
        yield from line


def normal(unit: str) -> str:
    return " ".join(unit.lower().split()).strip(".,;:!?\"'()[]{}«»“”‘’*-#%&$ ")


def digest(kind: bytes, unit: str) -> tuple[int, int]:
    """128 bits, as two numbers."""
    return struct.unpack("<qq", hashlib.blake2b(normal(unit).encode("utf-8", "surrogatepass"), digest_size=16, person=kind).digest())


def units(docs: DataFrame, short: int = SHORT, lines: bool = False) -> DataFrame:
    """(doc_id, text_hash, line, place, start, end, first_word, last_word, high, low, again) of each unit of at least ``short`` words of ``docs(doc_id, text)``, and of each line if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "line", "place", "start", "end", "first_word", "last_word", "high", "low", "again"]
        kinds = [None, pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        for whole in batches:
            kinds[0] = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows: list[tuple] = []
                for doc_id, text, text_hash in zip(*(c.to_pylist() for c in batch.columns)):
                    place = word = 0
                    seen: set[tuple[int, int]] = set()
                    for number, line in enumerate(cut_lines(text or "")):
                        before = word
                        for start, end in line:
                            unit = text[start:end]
                            n = len(unit.split())
                            if n >= short:
                                d = digest(b"", unit)
                                rows.append((doc_id, text_hash, False, place, start, end, word, word + n, *d, d in seen))
                                seen.add(d)
                                place += 1
                            word += n
                        start, end = line[0][0], line[-1][1]
                        if lines and any(map(str.isalnum, text[start:end])):
                            d = digest(b"line", text[start:end])
                            rows.append((doc_id, text_hash, True, number, start, end, before, word, *d, d in seen))
                            seen.add(d)
                cols = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, text_hash long, line boolean, place int, start int, end int, first_word int, last_word int, high long, low long, again boolean")


def repeated_passages(docs: DataFrame, short: int = SHORT, least: int = LEAST, lines: bool = False) -> DataFrame:
    """(doc_id, text_hash, start, end, n_words, first_doc_id): every passage to remove from ``docs(doc_id, text)``; ``text_hash`` is Spark's ``xxhash64(text)``, by which texts that share a doc_id are told apart."""
    found = units(docs, short, lines)
    rank = F.coalesce(F.col("doc_id"), F.lit(LAST))
    firsts = found.groupBy("high", "low").agg(F.min(rank).alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = found.join(firsts, ["high", "low"]).where(F.col("again") | (rank > F.col("first_doc")))
    marked = marked.select("doc_id", "text_hash", "line", "place", "start", "end", "first_word", "last_word", "first_doc").distinct()
    number = F.row_number().over(Window.partitionBy("doc_id", "text_hash", "line").orderBy("place"))
    runs = marked.withColumn("run", F.when(F.col("line"), F.col("place")).otherwise(F.col("place") - number)).groupBy("doc_id", "text_hash", "line", "run")
    spans = [F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.min("first_doc").alias("first_doc")]
    out = runs.agg(*spans).where(F.col("line") | (F.col("last_word") - F.col("first_word") >= least))
    if lines:
        earlier = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("end"), "line")
        reached = F.coalesce(F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
        out = out.withColumn("begins", (F.col("start") >= reached).cast("int")).withColumn("passage", F.sum("begins").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.groupBy("doc_id", "text_hash", "passage").agg(*spans)
    n_words = (F.col("last_word") - F.col("first_word")).cast("int")
    return out.select("doc_id", "text_hash", "start", "end", n_words.alias("n_words"), F.when(F.col("first_doc") < LAST, F.col("first_doc")).alias("first_doc_id"))


def remove(docs: DataFrame, short: int = SHORT, least: int = LEAST, lines: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` without the repeated passages, and ``removed``: their (start, end) in the original text, null where nothing was.

    Defined results: null and empty texts stay as they are; texts that share a doc_id are cut each at its own passages; a column ``removed``
    of ``docs`` stays, and the new one has as many underscores before its name as make it free; an empty table stays empty.
    """
    spans = repeated_passages(docs.select("doc_id", "text"), short, least, lines)
    removed, id_, hash_ = (free_name(docs.columns, x) for x in ("removed", "of_doc_id", "of_text"))
    per = spans.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(removed))
    out = docs.join(per, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left").drop(id_, hash_)
    rest = (
        f"aggregate({removed}, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', x.end, 'out', "
        "concat(a.out, substring(text, a.at + 1, x.start - a.at))), a -> concat(a.out, substring(text, a.at + 1)))"
    )
    return out.withColumn("text", F.when(F.col(removed).isNotNull(), F.expr(rest)).otherwise(F.col("text")))


def op7_repeats(docs: DataFrame, lines: bool = False) -> DataFrame:
    return repeated_passages(docs.select("doc_id", "text"), lines=lines)
