"""Sinks: the rows of reports and exports, and writing them partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT = ["framework_key", "tier", "jurisdiction", "uid", "identifier", "title", "text", "section_ref", "obligation", "provenance", "score", "rank", "structural"]


def export_rows(analysis: DataFrame) -> DataFrame:
    """The thirteen columns of an export: blanks squashed, a title that others share left out, a jurisdiction of 0 kept."""
    squash = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")).alias(c)
    out = analysis.withColumn("title", F.when(~F.coalesce("title_is_shared", F.lit(False)), F.col("title")))
    return out.select(*[squash(c) if c in ("title", "text", "section_ref") else F.col(c) for c in EXPORT])


def export_status(coverage: DataFrame, absent: DataFrame) -> DataFrame:
    """(framework_key, shown, total, state): coverage rows, and frameworks that couldn't be loaded with the reason."""
    return coverage.select("framework_key", "shown", "total", "state").union(absent.select("framework_key", F.lit(0).cast("long"), F.lit(0).cast("long"), F.concat(F.lit("absent: "), "reason")))


def result_groups(coverage: DataFrame, frameworks: DataFrame) -> DataFrame:
    """``coverage`` with the group under which it is shown (tiers 1 to 3 together) and its place there, by short name."""
    group = F.when(F.col("tier") <= 3, "1-3").otherwise(F.col("tier").cast("string"))
    return coverage.join(frameworks.select("framework_key", "short_name"), "framework_key").withColumn("group", group).orderBy("group", "short_name")


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "error") -> None:
    """Write as ``parquet``, ``csv`` (with a header) or ``json``, partitioned by columns if given."""
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*by) if by else writer).save(path)
