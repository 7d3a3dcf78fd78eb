"""Publishers' extracts as whole controls: titles, texts, tags and counts of grouped statements and maturity practices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.scan import numbered
from ledgerline.sources.extracts import STRENGTHS, first_of

COLUMNS = ("identifier", "title", "depth", "parent", "section_ref", "text", "obligation", "keyword", "parameters", "structural")


def _trimmed(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def statement_controls(groups: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(controls, counts, warnings) of ``groups(framework_key, group_key, title)`` and ``records(framework_key, group_key, section_number, section_title, keyword, text, parameters, load_seq)``.

    Controls are (framework_key, identifier, title, depth, parent, section_ref, text, obligation, keyword, parameters, structural): groups, sections and
    statements, numbered ``section#n`` by their place among the section's records that have a text. A group without a key and a section
    without a number are no controls of their own; their statements are numbered all the same and have no parent. A section is titled by its
    first record. Counts are (framework_key, kind, name, n) of parameters and keywords; a framework without a statement is warned of.
    """
    none = F.lit(None).cast("string")
    named = groups.select("framework_key", _trimmed("group_key").alias("group_key"), _trimmed("title").alias("group_title")).dropDuplicates(["framework_key", "group_key"])
    rows = records.select("framework_key", _trimmed("group_key").alias("group_key"), _trimmed("section_number").alias("number"), _trimmed("section_title").alias("section_title"), F.upper(_trimmed("keyword")).alias("keyword"), _trimmed("text").alias("text"), "parameters", "load_seq")
    rows = rows.where("text <> ''").join(named, ["framework_key", "group_key"], "left").withColumn("group_title", F.coalesce("group_title", F.lit("")))
    rows = rows.withColumn("section", F.when(F.col("group_key") != "", F.concat("group_key", F.lit(" §"), "number")).otherwise(F.col("number")))
    strength = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STRENGTHS.items() for x in kv]), F.col("keyword")), F.lit("unknown"))
    placed = numbered(rows, ["framework_key", "section"], ["load_seq"])
    ref = F.when(F.col("number") != "", F.concat("group_key", F.lit(" §"), "number", F.lit(" "), "section_title")).otherwise(F.col("group_title"))
    listed = F.coalesce(F.col("parameters"), F.array().cast("array<string>"))
    statements = placed.select(
        "framework_key", F.concat("section", F.lit("#"), F.col("nth").cast("string")).alias("identifier"), none.alias("title"), F.lit(2).alias("depth"), F.when(F.col("number") != "", F.col("section")).alias("parent"), ref.alias("section_ref"), "text",
        strength.alias("obligation"), F.nullif("keyword", F.lit("")).alias("keyword"), listed.alias("parameters"), F.lit(False).alias("structural"),
    )
    heading = (F.lit("").alias("text"), F.lit("informative").alias("obligation"), none.alias("keyword"), F.array().cast("array<string>").alias("parameters"), F.lit(True).alias("structural"))
    first = rows.where("number <> ''").groupBy("framework_key", "section").agg(F.min_by(F.struct("section_title", "group_key", "group_title"), "load_seq").alias("f"))
    sections = first.select("framework_key", F.col("section").alias("identifier"), F.nullif("f.section_title", F.lit("")).alias("title"), F.lit(1).alias("depth"), F.nullif("f.group_key", F.lit("")).alias("parent"), F.nullif("f.group_title", F.lit("")).alias("section_ref"), *heading)
    tops = named.where("group_key <> ''").select("framework_key", F.col("group_key").alias("identifier"), F.nullif("group_title", F.lit("")).alias("title"), F.lit(0).alias("depth"), none.alias("parent"), none.alias("section_ref"), *heading)
    words = rows.select("framework_key", F.lit("keyword").alias("kind"), F.coalesce(F.nullif("keyword", F.lit("")), F.lit("none")).alias("name"))
    counts = words.union(rows.select("framework_key", F.lit("parameter"), F.explode("parameters"))).groupBy("framework_key", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    empty = groups.select("framework_key").distinct().join(rows.select("framework_key").distinct(), "framework_key", "left_anti").select("framework_key", F.lit("no statements").alias("warning"))
    return tops.union(sections).union(statements), counts, empty


def practice_controls(practices: DataFrame, stated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(controls, warnings) of ``practices(framework_key, domain, objective_number, objective, identifier, text, mil, load_seq)`` and ``stated(framework_key, stated)``.

    Domains and objectives come from the practices: an objective is titled by its first practice. Controls are (framework_key, identifier, title,
    depth, parent, section_ref, text, level, structural), parents by identifier; the first row of an identifier stays. Warnings: an extract
    without practices, one with another number of rows than it states.
    """
    none = F.lit(None).cast("string")
    code = F.concat("domain", F.lit("-"), F.col("objective_number").cast("string"))
    rows = practices.withColumn("code", code)
    head = (F.lit("").alias("text"), none.alias("level"), F.lit(True).alias("structural"))
    domains = rows.select("framework_key", "domain").distinct().select("framework_key", F.col("domain").alias("identifier"), F.col("domain").alias("title"), F.lit(0).alias("depth"), none.alias("parent"), none.alias("section_ref"), *head)
    objectives = rows.groupBy("framework_key", "domain", "code").agg(F.min_by("objective", "load_seq").alias("title"))
    objectives = objectives.select("framework_key", F.col("code").alias("identifier"), "title", F.lit(1).alias("depth"), F.col("domain").alias("parent"), F.col("domain").alias("section_ref"), *head)
    level = F.when(F.col("mil") > 0, F.concat(F.lit("MIL"), F.col("mil").cast("string")))
    leaves = first_of(rows, ["framework_key", "identifier"]).select("framework_key", "identifier", none.alias("title"), F.lit(2).alias("depth"), F.col("code").alias("parent"), F.concat_ws(" ", "domain", "objective").alias("section_ref"), "text", level.alias("level"), F.lit(False).alias("structural"))
    n = practices.groupBy("framework_key").agg(F.count(F.lit(1)).alias("n"))
    met = stated.join(n, "framework_key", "left")
    said = F.when(F.col("n").isNull(), F.lit("no practices")).when((F.col("stated") > 0) & (F.col("n") != F.col("stated")), F.concat_ws(" ", F.lit("practices:"), F.col("n").cast("string"), F.lit("of"), F.col("stated").cast("string")))
    return domains.union(objectives).union(leaves), met.select("framework_key", said.alias("warning")).where("warning is not null")
