"""Published tables and sheets as controls: guides, requirement tables, practices, hierarchical sheets, mapping rows.

Every loader returns rows of (uid, parent_uid, depth, title, text, obligation) and what it could not place. Of several rows
with one identifier the first by ``load_seq`` stays. Blank cells count as missing; a row without an identifier or a text is no control.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.identifiers import normalise
from ledgerline.sources.extracts import filled, first_of

CONTROL = ["uid", "parent_uid", "depth", "title", "text", "obligation"]


def column_like(df: DataFrame, prefix: str) -> str | None:
    """The first column whose name begins with ``prefix``, in either case."""
    return next((c for c in df.columns if c.lower().startswith(prefix.lower())), None)


def _cell(name: str | None) -> Column:
    """A trimmed cell, null if blank or if there is no such column."""
    return F.lit(None).cast("string") if name is None else F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit(""))


def _uid(framework: str, identifier: Column) -> Column:
    """Null where there is no identifier."""
    return F.when(identifier.isNotNull(), F.concat(F.lit(f"{framework}:"), normalise(identifier)))


def _level(rows: DataFrame, uid: Column, parent: Column, depth: int, title: Column, text: Column, obligation: Column) -> DataFrame:
    """One level of a hierarchy: the first row of each uid; rows whose uid is null go."""
    out = rows.select(uid.alias("uid"), parent.alias("parent_uid"), F.lit(depth).alias("depth"), title.alias("title"), F.coalesce(text, F.lit("")).alias("text"), obligation.alias("obligation"), "load_seq")
    return first_of(out.where("uid is not null"), ["uid"]).select(CONTROL)


def guide_controls(guides: DataFrame, records: DataFrame, framework: str) -> DataFrame:
    """Guides, their sections and the recommendations in them.

    ``guides(report, title, load_seq)``: what stands before the colon of a report identifies it. ``records(report, identifier,
    section_number, section_title, heading, text, load_seq)``: a section bears the first word of its record's identifier and its number.
    """
    none, told = F.lit(None).cast("string"), F.lit("informative")
    report = lambda: _uid(framework, F.trim(F.substring_index("report", ":", 1)))
    section = F.concat_ws(" ", F.substring_index(F.trim("identifier"), " ", 1), _cell("section_number"))
    section = _uid(framework, F.when(_cell("section_number").isNotNull(), section))
    top = _level(guides, report(), none, 0, _cell("title"), none, told)
    middle = _level(records, section, report(), 1, _cell("section_title"), none, told)
    stated = records.where(filled("text"))
    return top.union(middle).union(_level(stated, _uid(framework, F.col("identifier")), section, 2, _cell("heading"), _cell("text"), F.lit("recommended")))


def requirement_controls(records: DataFrame, framework: str, text: list[str], decided: list[str], ceased: str) -> DataFrame:
    """Domains, sections and requirements of ``records(req_number, Domain, Section, load_seq, ...)``, with ``ceased``.

    ``text`` and ``decided`` are beginnings of column names: the requirement's text is in the first that exists, and it has
    ceased if any cell of the others matches the pattern; then it is informative, else mandatory. Without a text column: ValueError.
    """
    named = next((c for c in (column_like(records, p) for p in text) if c), None)
    if named is None:
        raise ValueError(f"no column begins with any of {text}")
    none, told = F.lit(None).cast("string"), F.lit("informative")
    rows = records.select(_cell("req_number").alias("n"), _cell("Domain").alias("domain"), _cell("Section").alias("section"), _cell(named).alias("text"),
        F.coalesce(F.concat_ws("\n", *[_cell(column_like(records, p)) for p in decided]).rlike(f"(?i){ceased}"), F.lit(False)).alias("ceased"), "load_seq").where("n is not null and text is not null")
    domain = _uid(framework, F.col("domain"))
    section = _uid(framework, F.concat(F.coalesce("domain", F.lit("")), F.lit(" "), F.substring_index("section", ".", 1)))
    out = _level(rows, domain, none, 0, F.col("domain"), none, told).union(_level(rows, section, domain, 1, F.col("section"), none, told)).withColumn("ceased", F.lit(False))
    uid = _uid(framework, F.concat(F.lit("req "), "n"))
    last = first_of(rows.withColumn("uid", uid), ["uid"])
    return out.union(last.select("uid", F.coalesce(section, domain), F.lit(2), none, "text", F.when(F.col("ceased"), "informative").otherwise("mandatory"), "ceased"))


def practice_controls(rows: DataFrame, framework: str, tags: list[str]) -> DataFrame:
    """Domains, objectives and practices of ``rows(domain, objective_id, objective, practice_id, practice, load_seq)``, with a map of the filled columns ``tags``."""
    none, told = F.lit(None).cast("string"), F.lit("unknown")
    rows = rows.where(filled("practice_id") & filled("practice"))
    domain, objective, practice = (_uid(framework, _cell(c)) for c in ("domain", "objective_id", "practice_id"))
    empty = F.create_map().cast("map<string,string>")
    upper = _level(rows, domain, none, 0, F.initcap(_cell("domain")), none, told).union(_level(rows, objective, domain, 1, none, _cell("objective"), told)).withColumn("tags", empty)
    last = first_of(rows.withColumn("__uid", practice), ["__uid"])
    said = F.map_filter(F.create_map(*[x for t in tags for x in (F.lit(t), _cell(t))]), lambda k, v: v.isNotNull()) if tags else empty
    return upper.union(last.select("__uid", objective, F.lit(2), none, _cell("practice"), told, said))


def hierarchical_sheet(rows: DataFrame, framework: str, group: str, leaf: str, withdrawn: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Controls of a sheet whose function and category stand above their rows; (identifier, targets) of withdrawn ones; (uid, source, identifier) of references.

    ``rows(document, load_seq, function, category, subcategory, refs)``. ``group`` and ``leaf`` are patterns with an identifier and the
    text behind it as groups; ``withdrawn`` finds texts of withdrawn rows, ``target`` (group 1) the identifiers they name. A function
    cell without text only closes a block. A function that comes again doesn't become the current one; a withdrawn category does.
    A reference is a line ``source: identifier``.
    """
    none = F.lit(None).cast("string")
    level = F.when(filled("function"), 0).when(filled("category"), 1).when(filled("subcategory"), 2)
    cell = F.trim(F.coalesce(*[F.when(filled(c), F.col(c)) for c in ("function", "category", "subcategory")]))
    read = rows.select("document", "load_seq", level.alias("depth"), cell.alias("cell"), "refs").where("depth is not null")
    part = lambda n: F.when(F.col("cell").rlike(leaf), F.regexp_extract("cell", leaf, n)).otherwise(F.regexp_extract("cell", group, n))
    read = read.withColumns({"id": F.nullif(part(1), F.lit("")), "text": F.trim(part(2))})
    read = read.where("id is not null and (depth > 0 or text <> '')")
    nth = F.row_number().over(Window.partitionBy("document", "id", "depth").orderBy("load_seq"))
    read = read.withColumn("nth", nth).where("depth > 0 or nth = 1")
    above = Window.partitionBy("document").orderBy("load_seq").rowsBetween(Window.unboundedPreceding, 0)
    read = read.withColumns({k: F.last(F.when(F.col("depth") == d, F.col("id")), ignorenulls=True).over(above) for d, k in ((0, "__f"), (1, "__c"))})
    gone = (F.col("depth") > 0) & F.col("text").rlike(withdrawn)
    live = read.where(~gone)
    title = F.when(F.col("depth") < 2, F.nullif(F.trim(F.substring_index("cell", "(", 1)), F.lit("")))
    parent = F.when(F.col("depth") == 1, F.col("__f")).when(F.col("depth") == 2, F.col("__c"))
    out = live.select(_uid(framework, F.col("id")).alias("uid"), _uid(framework, parent).alias("parent_uid"), "depth", title.alias("title"), "text", F.lit("unknown").alias("obligation"), "document", "load_seq")
    out = first_of(out.withColumn("load_seq", F.struct("document", "load_seq")), ["uid"]).select(CONTROL)
    named = F.filter(F.regexp_extract_all("text", F.lit(target), F.lit(1)), lambda t: t != F.col("id"))
    moved = read.where(gone).groupBy("id").agg(F.max_by(named, F.struct("document", "load_seq")).alias("targets")).withColumnRenamed("id", "identifier")
    lines = live.where("depth = 2").select(_uid(framework, F.col("id")).alias("uid"), F.explode(F.split(F.coalesce("refs", F.lit("")), "\n")).alias("l"))
    lines = lines.withColumn("l", F.rtrim(F.trim("l"), F.lit(","))).where("contains(l, ':')")
    cited = lines.select("uid", F.trim(F.substring_index("l", ":", 1)).alias("source"), F.trim(F.expr("substring(l, instr(l, ':') + 1)")).alias("identifier"))
    return out, moved, cited.where("identifier <> ''")


def reference_links(cited: DataFrame, editions: DataFrame, controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_uid, target_uid, source) of references to an edition that is loaded; and those to anything else.

    ``editions(source, framework_key)`` names editions as they are cited, ``controls(uid, framework_key, identifier)``. A reference
    to a loaded edition whose identifier isn't there gives no row in either table.
    """
    known = controls.select("framework_key", normalise(F.col("identifier")).alias("__k"), F.col("uid").alias("target_uid"))
    here = cited.join(editions, "source").withColumn("__k", normalise(F.col("identifier")))
    return here.join(known, ["framework_key", "__k"]).select(F.col("uid").alias("source_uid"), "target_uid", "source"), cited.join(editions, "source", "left_anti")


def stored_number(cell: Column) -> Column:
    """An identifier as a numeric cell keeps it: 3.10 is 3.1, 4.0 is 4, up to ten decimals; what is no number stays."""
    text = F.trim(F.translate(F.coalesce(cell, F.lit("")), "\u00a0", " "))
    number = F.when(text.rlike(r"^-?\d+\.?\d*$"), text).try_cast("double").try_cast("decimal(38,10)").cast("string")
    return F.coalesce(F.regexp_replace(number, r"\.?0+$", ""), text)


def mapping_tags(rows: DataFrame, controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, strategy, relationship), once each, of mapping rows that name exactly one control; and (number, title, candidates) of those that don't.

    ``rows(number, title, strategy, relationship)``, ``controls(uid, identifier, title)``. Both sides are compared as numeric cells keep
    them; where that leaves several controls, the title decides. Rows without a number, strategy or relationship are not mapped.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\u00a0", " "), r"\s+", " ")))
    said = rows.where(filled("number") & filled("strategy") & filled("relationship"))
    said = said.select(stored_number(F.col("number")).alias("number"), "title", plain(F.col("title")).alias("__t"), F.trim("strategy").alias("strategy"), F.trim("relationship").alias("relationship")).distinct()
    known = controls.select(stored_number(F.col("identifier")).alias("number"), plain(F.col("title")).alias("__ct"), "uid")
    counts = known.groupBy("number").agg(F.count(F.lit(1)).alias("__n"), F.min("uid").alias("__uid"))
    titled = known.groupBy("number", F.col("__ct").alias("__t")).agg(F.count(F.lit(1)).alias("__m"), F.min("uid").alias("__tuid"))
    met = said.join(counts, "number", "left").join(titled, ["number", "__t"], "left")
    met = met.withColumn("uid", F.when(F.col("__n") == 1, F.col("__uid")).when(F.col("__m") == 1, F.col("__tuid")))
    lost = met.where("uid is null").select("number", "title", F.coalesce(F.when(F.col("__n") > 1, F.coalesce("__m", F.lit(0))), F.col("__n"), F.lit(0)).alias("candidates"))
    return met.where("uid is not null").select("uid", "strategy", "relationship").distinct(), lost.distinct()
