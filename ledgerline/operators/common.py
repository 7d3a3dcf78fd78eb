"""What operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table counts as a rule table.
RULES = 10_000


def if_small(df: DataFrame, most: int = RULES) -> DataFrame:
    """``df`` to be sent to every task if it has at most ``most`` rows, counted beforehand up to that many; else as it is, for Spark to decide.

    For joins by a pattern or a substring, which have no key to shuffle by: a larger table is met block by block.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def phrases_said(texts: DataFrame, phrases: DataFrame, key: str, most: int = RULES) -> DataFrame:
    """(key, phrase) of every phrase of ``phrases(phrase)`` that stands in a text of ``texts(key, text)`` as a substring, in any case.

    Up to ``most`` phrases, counted first, go to every task as one automaton that each text runs through once. More phrases meet the
    texts by shuffle: on a phrase's rarest run of three letters (or the whole, if it is shorter), which a text must have, and are then looked for.
    Repeated keys are told apart by their texts; an empty phrase stands in every text, a null text or phrase in none.
    """
    wanted = phrases.select("phrase").where("phrase is not null").distinct()
    said = texts.select(key, F.lower("text").alias("text")).where("text is not null")
    if wanted.limit(most + 1).count() > most:
        return _by_rarest_gram(said, wanted, key)
    low = [(r.low, r.phrase) for r in wanted.select(F.lower("phrase").alias("low"), "phrase").collect()]  # at most ``most`` rows

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by, machine = {}, ahocorasick.Automaton()
        for lowered, phrase in low:
            by.setdefault(lowered, []).append(phrase)
        for lowered in by:
            if lowered:
                machine.add_word(lowered, lowered)
        machine.make_automaton()
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                hits = {lowered for _, lowered in machine.iter(text)} if len(machine) else set()
                for lowered in sorted(hits | ({""} & by.keys())):
                    rows += [k] * len(by[lowered])
                    found += by[lowered]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], [key, "phrase"])

    kind = texts.schema[key].dataType.simpleString()
    return said.mapInArrow(search, f"`{key}` {kind}, phrase string")


def _by_rarest_gram(said: DataFrame, wanted: DataFrame, key: str, width: int = 3) -> DataFrame:
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda at: F.substring(c, at, F.lit(n))))
    said = said.withColumn("__row", F.monotonically_increasing_id())
    said = materialise(said)
    low = wanted.withColumn("low", F.lower("phrase"))
    everywhere = low.where("low = ''")
    parts = low.where("low <> ''").select("phrase", "low", F.explode(F.when(F.length("low") >= width, grams("low", width)).otherwise(F.array("low"))).alias("gram"))
    lengths = [n for n in range(1, width + 1)]
    have = said.select("__row", F.explode(F.flatten(F.array(*[F.when(F.length("text") >= n, grams("text", n)).otherwise(F.array().cast("array<string>")) for n in lengths]))).alias("gram"))
    have = materialise(have.join(parts.select("gram").distinct(), "gram", "left_semi"))
    df = have.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rare = parts.join(df, "gram", "left").fillna(0, ["df"]).groupBy("phrase", "low").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.min("df").alias("least")).where("least > 0")
    met = have.join(rare, "gram").join(said, "__row").where(F.contains("text", F.col("low"))).select(key, "phrase")
    return met.union(said.select(key).join(everywhere.select("phrase"))) if not everywhere.isEmpty() else met  # one phrase


def written(df: DataFrame) -> DataFrame:
    """As ``materialise``, but written as compressed columns, a fraction of the rows' size: for tables as large as the input."""
    _checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def single(df: DataFrame, key: str) -> bool:
    """Whether no two rows have the same key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def semi_small(df: DataFrame, keys: DataFrame, on: str, most: int = 10 * RULES) -> DataFrame:
    """``df`` without the rows whose ``on`` is not among ``keys``, if these are few enough to be sent to every task (counted first); else all of it.

    For a large table before a join by which the same rows would go: they are dropped where they are read.
    """
    few = keys.select(on).distinct()
    return df.join(F.broadcast(few), on, "left_semi") if few.limit(most + 1).count() <= most else df


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder (``spark.checkpoint.dir``; a temporary one only where that is unset and everything runs in one process)."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
