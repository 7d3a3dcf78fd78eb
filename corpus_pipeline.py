"""A training-data pipeline over ``documents``: five stages, each an operator of ``ledgerline.llm``.

Each stage takes all that the one before it kept; the caller writes what a stage returns and reads it again
as the next one's ``docs``. All stages but the last return the columns of ``documents``:

1. ``language``: documents without an identified main language go; ``lang`` becomes the identified one.
2. ``near_duplicates``: one document of each class of near copies stays.
3. ``secrets``: secret spans are replaced in the text; no document goes.
4. ``mixing``: each document stays as often as the mix takes it, so a row may come up to three times.
5. ``pieces``: (doc_id, n_pieces, ids_sha256, lossless) of every row, encoded with merge-dropout.

Null texts go with the first stage; empty tables give empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import langid, mixing, near_dup, piece_codec, secrets
from ledgerline.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one_of_each(docs.select(*COLUMNS))


def find_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_taken(docs.select(*COLUMNS))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.op10_pieces(docs.select("doc_id", "text"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", find_secrets),
    ("mixing", mix_sources),
    ("pieces", pieces),
]

#: Learned shares, signatures and keyed merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are kept in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
