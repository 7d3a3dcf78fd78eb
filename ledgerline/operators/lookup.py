"""Identifier lookup in batch: an index of forms, a join for all queries, the first form with a match wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import identifiers as I


def identifier_index(controls: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(form, kind, uid, framework_key) of ``controls(uid, framework_key, identifier[, alternates ARRAY<STRING>])``; kind 0 is the primary key, 1 an alias."""
    base = controls.withColumn("__n", I.normalise(F.col("identifier"), ascii_only))
    primary = base.select(F.col("__n").alias("form"), F.lit(0).alias("kind"), "uid", "framework_key")
    alias = base.select(F.explode(F.filter(I.variants(F.col("__n")), lambda f: f != F.col("__n"))).alias("form"), F.lit(1).alias("kind"), "uid", "framework_key")
    out = primary.union(alias)
    if "alternates" in controls.columns:
        other = controls.select(F.explode("alternates").alias("__a"), "uid", "framework_key").withColumn("__n", I.normalise(F.col("__a"), ascii_only))
        out = out.union(other.select(F.explode(I.variants(F.col("__n"))).alias("form"), F.lit(1).alias("kind"), "uid", "framework_key"))
    return out.where("form <> ''").distinct()


def lookup(queries: DataFrame, index: DataFrame, words: DataFrame | None = None, redirects: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """(query_id, normalised, status, matched_form, uids) of ``queries(query_id, query)``.

    ``words(word, framework_key)`` are framework names that may stand before an identifier. A query that begins with a
    letter never matches by a form that begins with a digit. Primary forms go before aliases and, in each, the
    first form with any match decides. ``redirects(framework_key, identifier, target)`` answer for withdrawn identifiers.
    """
    q = queries.withColumn("raw", F.trim(F.coalesce("query", F.lit("")))).withColumn("shaped", I.looks_like(F.col("raw")))
    first = F.regexp_extract("raw", "^(\\S+)\\s", 1)
    q = q.withColumn("word", F.when(~first.rlike("[0-9]"), F.regexp_extract(F.lower(first), "^[a-z]+", 0)))
    if words is not None:
        q = q.join(words.withColumnRenamed("framework_key", "fw"), "word", "left")
    else:
        q = q.withColumn("fw", F.lit(None).cast("string"))
    q = q.withColumn("stripped", F.when(F.col("fw").isNotNull(), F.regexp_replace("raw", "^\\S+\\s+", "")).otherwise(F.col("raw")))
    q = q.withColumn("normalised", I.normalise(F.col("stripped"), ascii_only))
    forms = F.filter(I.variants(F.col("normalised")), lambda f: ~F.col("normalised").rlike("^[a-z]") | ~f.rlike("^[0-9]"))
    tried = q.where("shaped").select("query_id", "fw", F.posexplode(forms).alias("pos", "form"))
    hits = tried.join(index, "form").where("fw is null or fw = framework_key")
    first = Window.partitionBy("query_id")
    hits = hits.withColumn("at", F.struct("kind", "pos")).withColumn("best", F.min("at").over(first)).where("at = best")
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_set("uid")).alias("uids"), F.first("form").alias("matched_form"))
    out = q.join(found, "query_id", "left")
    if redirects is not None:
        gone = redirects.withColumn("form", I.normalise(F.col("identifier"), ascii_only)).withColumnRenamed("framework_key", "rfw")
        moved = tried.join(gone, "form").where("fw is null or fw = rfw").groupBy("query_id").agg(F.array_sort(F.collect_set("target")).alias("targets"))
        out = out.join(moved, "query_id", "left")
    else:
        out = out.withColumn("targets", F.lit(None).cast("array<string>"))
    status = (
        F.when(~F.col("shaped"), "not-an-identifier").when(F.size("uids") == 1, "unique").when(F.size("uids") > 1, "ambiguous").when(F.col("targets").isNotNull(), "withdrawn").otherwise("none")
    )
    return out.select("query_id", "normalised", status.alias("status"), "matched_form", "uids", "targets")
