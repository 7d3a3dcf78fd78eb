"""Loaders of publishers' extracts: tables of rows, as Spark reads them, become controls, links and warnings.

Blank cells count as missing. Rows keep ``load_seq``, which decides order and which of several rows is the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.common import phrases_said

# Obligation keywords of specifications and the strengths they state.
STRENGTHS = {"MUST": "mandatory", "SHALL": "mandatory", "MUST NOT": "prohibited", "SHALL NOT": "prohibited", "SHOULD": "recommended", "SHOULD NOT": "recommended", "MAY": "permitted"}


def filled(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) != ""


def first_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """The first loaded row of each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy("load_seq"))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def grouped_statements(records: DataFrame, framework: str) -> DataFrame:
    """(uid, parent_uid, depth, text, obligation, n_parameters): groups, their sections and the statements in them.

    ``records(group_key, section_number, keyword, text, parameters ARRAY, load_seq)``; records without text go. A statement
    is ``section#n`` by its place among its section's records, so it can't collide with a section's own number.
    """
    rows = records.where(filled("text")).withColumn("__s", F.concat("group_key", F.lit(" §"), "section_number"))
    uid = lambda c: F.concat(F.lit(f"{framework}:"), c)
    n = F.row_number().over(Window.partitionBy("__s").orderBy("load_seq"))
    named = F.create_map(*[F.lit(x) for kv in STRENGTHS.items() for x in kv])
    strength = F.coalesce(F.try_element_at(named, F.upper(F.trim(F.coalesce("keyword", F.lit(""))))), F.lit("unknown"))
    statements = rows.select(uid(F.concat("__s", F.lit("#"), n.cast("string"))).alias("uid"), uid(F.col("__s")).alias("parent_uid"), F.lit(2).alias("depth"), "text", strength.alias("obligation"), F.coalesce(F.size("parameters"), F.lit(0)).alias("n_parameters"))
    blank = [F.lit("").alias("text"), F.lit("informative").alias("obligation"), F.lit(0).alias("n_parameters")]
    sections = rows.select("group_key", "__s").distinct().select(uid(F.col("__s")).alias("uid"), uid(F.col("group_key")).alias("parent_uid"), F.lit(1).alias("depth"), *blank)
    groups = records.select("group_key").distinct().select(uid(F.col("group_key")).alias("uid"), F.lit(None).cast("string").alias("parent_uid"), F.lit(0).alias("depth"), *blank)
    return groups.union(sections).union(statements)


def shippable(guides: DataFrame, phrase: str) -> DataFrame:
    """(framework_key, shippable): whether every guide's licence of a framework holds the phrase."""
    return guides.groupBy("framework_key").agg(F.every(F.contains(F.lower(F.coalesce("licence", F.lit(""))), F.lit(phrase.lower()))).alias("shippable"))


def maturity_practices(practices: DataFrame, stated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, parent_uid, depth, level) of domains, objectives and practices; and (domain, stated, loaded) where the counts differ.

    ``practices(domain, objective, practice, level, load_seq)``, ``stated(domain, stated)``; the first row of a practice stays.
    """
    rows = first_of(practices, ["practice"])
    none = F.lit(None)
    domains = rows.select(F.col("domain").alias("uid"), none.cast("string").alias("parent_uid"), F.lit(0).alias("depth"), none.cast("int").alias("level")).distinct()
    objectives = rows.select(F.col("objective").alias("uid"), F.col("domain").alias("parent_uid"), F.lit(1).alias("depth"), none.cast("int").alias("level")).distinct()
    out = domains.union(objectives).union(rows.select("practice", "objective", F.lit(2), F.col("level").cast("int")))
    loaded = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("loaded"))
    counts = stated.join(loaded, "domain", "full").select("domain", F.coalesce("stated", F.lit(0)).alias("stated"), F.coalesce("loaded", F.lit(0)).alias("loaded"))
    return out, counts.where("stated <> loaded")


def policy_items(items: DataFrame, obligation) -> DataFrame:
    """(uid, parent_uid, depth, text, obligation) of sections and their items.

    ``items(section, identifier, lead_in, text, load_seq)``; ``obligation`` is a function of a text column, and the lead-in
    counts in it. An item that bears its section's own identifier gives the section its text and is no item.
    """
    read = obligation(F.concat_ws(" ", "lead_in", "text"))
    own = first_of(items.where("identifier = section"), ["section"]).select("section", F.col("text").alias("__t"), read.alias("__o"))
    sections = items.select("section").distinct().join(own, "section", "left")
    sections = sections.select(F.col("section").alias("uid"), F.lit(None).cast("string").alias("parent_uid"), F.lit(0).alias("depth"), F.coalesce("__t", F.lit("")).alias("text"), F.coalesce("__o", F.lit("informative")).alias("obligation"))
    rest = items.where("identifier <> section")
    return sections.union(rest.select(F.col("identifier"), F.col("section"), F.lit(1), F.col("text"), read))


def incorporations(rows: DataFrame, phrases: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_uid, target_uid, kind, provenance, basis) from table rows that name a document; and the rows that name none.

    ``rows(source_uid, cell, condition)``, ``phrases(phrase, framework_key, ord)`` (a rule table; the first phrase in order
    wins), ``roots(uid, framework_key, structural)``: links go to a framework's roots that aren't structural, to all if there is no other.
    """
    # each cell runs through the phrases once; what it says is joined back on the cell
    said = phrases_said(rows.select("cell", F.col("cell").alias("text")).distinct(), phrases, "cell").join(phrases, "phrase")
    first = said.groupBy("cell").agg(F.min_by("framework_key", "ord").alias("framework_key"))
    named = rows.select("source_uid", "cell", "condition").distinct().join(first, "cell", "left")
    plain = F.max((~F.col("structural")).cast("int")).over(Window.partitionBy("framework_key"))
    ends = roots.withColumn("__p", plain).where("not structural or __p = 0").select("framework_key", F.col("uid").alias("target_uid"))
    links = named.join(ends, "framework_key").select("source_uid", "target_uid", F.lit("incorporates").alias("kind"), F.lit("published").alias("provenance"), F.concat_ws("; ", "cell", "condition").alias("basis"))
    return links, named.where("framework_key is null").select("source_uid", "cell")


def completeness(provisions: DataFrame, expected: DataFrame) -> DataFrame:
    """(identifier, problem): expected provisions that lack, others that weren't expected, repeated ones, empty ones."""
    got = provisions.groupBy("identifier").agg(F.count(F.lit(1)).alias("__n"), F.max(filled("text")).alias("__f"))
    both = got.join(expected.select("identifier", F.lit(True).alias("__e")).distinct(), "identifier", "full")
    problems = F.array_compact(
        F.array(F.when(F.col("__n").isNull(), "missing"), F.when(F.col("__e").isNull(), "unexpected"), F.when(F.col("__n") > 1, "repeated"), F.when(~F.col("__f"), "empty"))
    )
    return both.select("identifier", F.explode(problems).alias("problem"))


def practice_references(rows: DataFrame, cell: str, pattern: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_uid, target_uid, maturity) of the references in a cell, blocks parted by an empty line; and (identifier, n) of those not known.

    The pattern's first group is the identifier, its second the maturity level.
    """
    blocks = rows.select("source_uid", F.explode(F.split(F.coalesce(F.col(cell), F.lit("")), r"\n\s*\n")).alias("b"))
    found = blocks.select("source_uid", F.regexp_extract("b", pattern, 1).alias("identifier"), F.regexp_extract("b", pattern, 2).try_cast("int").alias("maturity")).where("identifier <> ''").distinct()
    known = found.join(targets.select("identifier", F.col("uid").alias("target_uid")), "identifier", "left")
    return known.where("target_uid is not null").select("source_uid", "target_uid", "maturity"), known.where("target_uid is null").groupBy("identifier").agg(F.count(F.lit(1)).alias("n"))


def move_class(controls: DataFrame, moves: Column, framework: str, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Controls with one class moved to another framework, (old_uid, uid) aliases, and (identifier, problem) against the expected ones."""
    marked = controls.withColumn("__m", F.coalesce(moves, F.lit(False)))
    new = F.concat(F.lit(f"{framework}:"), "identifier")
    aliases = marked.where("__m").select(F.col("uid").alias("old_uid"), new.alias("uid"))
    out = marked.withColumn("uid", F.when(F.col("__m"), new).otherwise(F.col("uid"))).withColumn("framework_key", F.when(F.col("__m"), F.lit(framework)).otherwise(F.col("framework_key")))
    moved = marked.where("__m").select("identifier", "text")
    problems = completeness(moved, moved if expected is None else expected)
    return out.drop("__m"), aliases, problems


def load_details(recommendations: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_key, identifier, title, text): description and rationale as one text, the first of each; and sources whose number differs from ``sources(source_key, expected)``."""
    out = first_of(recommendations, ["source_key", "identifier"]).select("source_key", "identifier", "title", F.concat_ws("\n\n", "description", "rationale").alias("text"))
    n = out.groupBy("source_key").agg(F.count(F.lit(1)).alias("loaded"))
    counts = sources.join(n, "source_key", "left").select("source_key", "expected", F.coalesce("loaded", F.lit(0)).alias("loaded"))
    return out, counts.where("expected <> loaded")


def merge_checks(checks: DataFrame, procedures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(control_id, check_id, title, command) for each parent of a check; and (control_id, uid, basis), the last check of a control in title order winning a uid.

    ``checks(check_id, title, platform, parents ARRAY, references ARRAY)``, ``procedures(check_id, command)``.
    """
    rows = checks.join(procedures, "check_id").withColumn("control_id", F.explode("parents"))
    basis = F.concat_ws(" · ", "check_id", "platform")
    cited = rows.select("control_id", "title", "check_id", basis.alias("basis"), F.explode("references").alias("uid"))
    mappings = cited.groupBy("control_id", "uid").agg(F.max_by("basis", F.struct(F.lower("title"), "check_id")).alias("basis"))
    return rows.select("control_id", "check_id", "title", "command"), mappings


def stamp_revision(frameworks: DataFrame, claims: DataFrame) -> DataFrame:
    """``frameworks`` with ``revision`` and ``revision_source`` of the first claim that isn't blank; ``claims(framework_key, source, cell, pattern, ord)``, group 1 of the pattern."""
    said = claims.withColumn("__v", F.expr("regexp_extract(coalesce(cell, ''), pattern, 1)")).where("__v <> ''")
    said = said.groupBy("framework_key").agg(F.min_by(F.struct(F.col("__v").alias("revision"), F.col("source").alias("revision_source")), "ord").alias("__c"))
    return frameworks.join(said, "framework_key", "left").select(*frameworks.columns, "__c.revision", "__c.revision_source")
