"""What the training-data operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a table of runs is sent to every task.
SMALL = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 1) -> DataFrame:
    """Join on columns of the same names where null equals null; the right side's keys go.

    With ``salts``, for a right side of a row or so a key, each of its rows is sent that many times and the
    left rows of a key are dealt over as many tasks, by a digest of the whole row.
    """
    if salts > 1:
        left = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
        right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return null_join(left, right, [*on, "__salt"], how).drop("__salt")
    for k in on:
        right = right.withColumnRenamed(k, f"__{k}")
    match = F.lit(True)
    for k in on:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, match, how).drop(*[f"__{k}" for k in on])


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a local session that names none
    gets a temporary folder. On a cluster without the setting this is an error: no machine's own disk will do.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def sampled(salt: str, key, bound: int, total: int) -> Column:
    """Whether a row is among about ``bound`` of ``total`` rows, by a keyed hash of ``key``; 63 bits, so the share is never rounded to none."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), key), 1) < F.lit(min((1 << 63) - 1, (bound << 63) // max(total, 1)))


def by_key(rows: DataFrame, per: DataFrame, key: str, members: str, share: int = 500) -> DataFrame:
    """``rows`` joined with ``per``, which holds one row a key with the number of its ``members`` in rows; both should be written tables.

    Keys with over one in ``share`` of all rows, at most ``share`` of them, are sent to every task, so that no key's rows
    meet in one; all other keys are joined by shuffle.
    """
    total = per.agg(F.sum(members)).first()[0] or 0
    hot = per.where(F.col(members) > max(1000, total // share))
    if not total or hot.isEmpty():
        return rows.join(per, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per.where(F.col(members) <= max(1000, total // share)), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def numbered(rows: DataFrame, group: list[str], order: list[Column], place: str = "idx", size: str = "n") -> DataFrame:
    """``rows`` with their ``place`` (from 0) in the order of their group and the ``size`` of the group. Group columns hold no nulls.

    No group is sorted in one task: the rows are dealt by ranges of (group, order), and what a range holds of a group starts at
    the number of that group's rows in the ranges before. Rows that are equal in ``order`` are numbered in any order, once and for all.
    ``order`` should tell apart what many rows share, since equal rows lie in one range.
    """
    at, part, first, before, here = (free_name(rows.columns, x) for x in ("at", "part", "first", "before", "here"))
    keys = [F.col(c) for c in group]
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(at, F.monotonically_increasing_id())
    dealt = materialise(dealt.withColumn(part, F.shiftrightunsigned(at, 33)))
    runs = dealt.groupBy(*keys, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(here))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(runs.withColumn(before, F.coalesce(F.sum(here).over(earlier), F.lit(0))).withColumn(size, F.sum(here).over(whole)))
    if runs.limit(SMALL + 1).count() <= SMALL:
        runs = F.broadcast(runs)
    return dealt.join(runs, [*group, part]).withColumn(place, F.col(at) - F.col(first) + F.col(before)).drop(at, part, first, before, here)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, as a path that Spark's readers and writers take."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, label)`` for each node that has an edge.

    Every round each node hooks onto its smallest neighbour, the edges are relabelled and those that
    became loops or repeats go. Labels should be spread at random over the nodes (a digest is), so the
    number of nodes left falls by a constant factor a round; there are as many rounds as the logarithm
    of the longest chain, each of them a few shuffles of what is left. No links reach the driver.
    The label is one of the component's nodes, the same at every run, though not always the smallest.
    """
    live = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = materialise(live)
    labels = None
    while True:
        both = live.union(live.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        hook = materialise(hook.select("node", F.least("node", "m").alias("label")))
        if labels is None:
            labels = hook
        else:
            step = hook.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = materialise(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        ha = hook.select(F.col("node").alias("a"), F.col("label").alias("la"))
        hb = hook.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        live = live.join(ha, "a").join(hb, "b").where("la <> lb")
        live = materialise(live.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        if live.isEmpty():
            return labels


_kept: dict = {}


def per_worker(key, build):
    """What ``build`` makes, made once in each Python worker and kept until the worker makes something for another key, so stages don't add up their memory."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]
