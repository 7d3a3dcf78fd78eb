"""Documents as ordered blocks: levels, provisions and their lines, tables under headings; documents may be of any length."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.common import materialise
from ledgerline.operators.scan import numbered, ordered_scan


@dataclass(frozen=True)
class Style:
    """What blocks of a style are: ``role`` is skip, end, level0, level1, ..., section, subsection, more or note.

    ``head`` parts the text of a heading, section or subsection into its number and the rest. ``name`` makes the identifier of a
    section or subsection out of ``{number}``, ``{section}`` and ``{prefix}``, which is the document part's entry among the prefixes.
    """

    pattern: str
    role: str
    head: str | None = None
    name: str = "{number}"


def _chosen(styles: list[Style], of) -> Column:
    out = F.lit(None)
    for k in reversed(range(len(styles))):
        out = F.when(F.col("__k") == k, of(styles[k])).otherwise(out)
    return out


def assemble_levels(blocks: DataFrame, styles: list[Style], prefixes: dict[str, str] | None = None, section_depth: int | None = None, sections_take_lines: bool = False) -> DataFrame:
    """(doc, idx, role, identifier, title, depth, parent, section_ref, text, notes, structural) from styled ``blocks(doc, idx, style, text)``.

    The first style whose pattern finds the block's style says what it is. A level is named after its number, and after the level above
    it if that is open; it ends all deeper ones, the section and the provision that were open. A section lies under the deepest open
    level; one without a number only ends what was open. A numbered subsection is a provision of its own, one without a number belongs to
    the section, and further lines go to whichever of them is open (with ``sections_take_lines`` to a section right after its heading).
    Lines where nothing is open, and everything after an ``end`` block, are left out. Headings and sections without text are structural.
    """
    depth = max((int(s.role[5:]) for s in styles if s.role.startswith("level")), default=-1) + 1
    kind = F.coalesce(*[F.when(F.col("style").rlike(s.pattern), F.lit(k)) for k, s in enumerate(styles)])
    rows = blocks.select("doc", "idx", "style", F.trim("text").alias("text")).withColumn("__k", kind).where(F.col("__k").isNotNull() & F.coalesce(F.col("text") != "", F.lit(False)))
    rows = rows.withColumn("role", _chosen(styles, lambda s: F.lit(s.role))).where("role <> 'skip'")
    rows = rows.withColumn("fits", F.coalesce(_chosen(styles, lambda s: F.col("text").rlike(s.head) if s.head else F.lit(False)), F.lit(False)))
    part = lambda n: _chosen(styles, lambda s: F.trim(F.regexp_extract("text", s.head, n)) if s.head else F.lit(None))
    rows = rows.withColumn("number", F.when(F.col("fits"), part(1)).otherwise(F.left("text", F.lit(24)))).withColumn("rest", F.when(F.col("fits"), part(2)).otherwise(""))
    is_level = F.col("role").startswith("level")
    at = F.when(is_level, F.substring("role", 6, 2).try_cast("int"))
    rows = rows.withColumn("at", at)
    void = lambda *types: F.struct(*[F.lit(None).cast(t).alias(n) for n, t in types])
    idx = blocks.schema["idx"].dataType
    section, open_ = (("number", "string"), ("title", "string"), ("idx", idx)), (("number", "string"), ("idx", idx))
    fills = {f"l{d}": F.when(F.col("at") == d, F.struct(F.col("number").alias("number"))).when(F.col("at") < d, void(("number", "string"))) for d in range(depth)}
    fills["section"] = F.when((F.col("role") == "section") & F.col("fits"), F.struct(F.col("number").alias("number"), F.col("rest").alias("title"), F.col("idx").alias("idx"))).when(is_level | (F.col("role") == "section"), void(*section))
    starts = F.when((F.col("role") == "subsection") & F.col("fits"), F.struct(F.col("number").alias("number"), F.col("idx").alias("idx")))
    starts = starts.when(F.col("role") == "subsection", F.struct(F.lit("").alias("number"), F.lit(None).cast(idx).alias("idx")))
    if sections_take_lines:
        starts = starts.when((F.col("role") == "section") & F.col("fits"), F.struct(F.lit("").alias("number"), F.lit(None).cast(idx).alias("idx")))
    fills["open"] = starts.when(is_level | (F.col("role") == "section"), void(*open_))
    rows = ordered_scan(rows, ["doc"], ["idx"], fills, {"ended": F.col("role") == "end"}).where("ended = 0")

    # identifiers of the open levels, each after the one above it
    names: list[Column] = []
    for d in range(depth):
        number = F.col(f"l{d}.number")
        names.append(F.when(number.isNotNull(), F.concat_ws(" ", names[d - 1], number) if d else number))
    named = [F.col(f"__n{d}") for d in range(depth)]
    for d, n in enumerate(names):
        rows = rows.withColumn(f"__n{d}", n)
    under = F.coalesce(*reversed(named)) if named else F.lit(None).cast("string")
    level = reduce(lambda acc, d: F.when(F.col(f"__n{d}").isNotNull(), F.lit(d)).otherwise(acc), range(depth), F.lit(-1))
    prefix = F.lit("")
    for top, p in (prefixes or {}).items():
        prefix = F.when(named[0] == top, F.lit(p)).otherwise(prefix)

    def called(number: Column) -> Column:
        name = _chosen(styles, lambda s: F.lit(s.name))
        return F.replace(F.replace(F.replace(name, F.lit("{number}"), number), F.lit("{section}"), F.coalesce("section.number", F.lit(""))), F.lit("{prefix}"), prefix)

    depth_of = F.lit(section_depth) if section_depth is not None else level + 1
    rows = rows.withColumn("__depth", depth_of).withColumn("called", called(F.col("number"))).withColumn("__under", under)
    rows = materialise(rows.select("doc", "idx", "role", "fits", "at", "text", "number", "rest", "section", "open", "__depth", "called", "__under", *[f"__n{d}" for d in range(depth)]))

    none = F.lit(None).cast("string")
    out = "doc", "idx", "role"
    pick = lambda cols: F.get(F.array(*cols), F.col("at")) if cols else none
    levels = rows.where(is_level).select(*out, pick(named).alias("identifier"), F.nullif("rest", F.lit("")).alias("title"), F.col("at").alias("depth"), F.when(F.col("at") > 0, pick([none, *named[:-1]])).alias("parent"), none.alias("section_ref"))
    sections = rows.where("role = 'section' and fits").select(*out, F.col("called").alias("identifier"), F.nullif("rest", F.lit("")).alias("title"), F.col("__depth").alias("depth"), F.col("__under").alias("parent"), none.alias("section_ref"))
    inner = rows.where("role = 'subsection' and fits and section.idx is not null")
    subs = inner.select(*out, F.col("called").alias("identifier"), none.alias("title"), (F.col("__depth") + 1).alias("depth"), F.col("section.idx").alias("__s"), F.col("section.title").alias("section_ref"))
    parents = sections.select("doc", F.col("idx").alias("__s"), F.col("identifier").alias("parent"))
    subs = subs.join(parents, ["doc", "__s"]).select(*out, "identifier", "title", "depth", "parent", "section_ref")

    said = rows.where("section.idx is not null and open.number is not null").withColumn("owner", F.coalesce("open.idx", "section.idx"))
    line = F.when(F.col("fits") & (F.col("role") == "subsection"), F.col("rest")).otherwise(F.col("text"))
    gathered = said.where("role in ('subsection', 'more')").groupBy("doc", "owner").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("s"))
    texts = gathered.select("doc", F.col("owner").alias("idx"), F.trim(F.array_join("s.line", "\n")).alias("text"))
    noted = said.where("role = 'note'").groupBy("doc", F.col("owner").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("notes"))
    controls = levels.unionByName(sections).unionByName(subs).join(texts, ["doc", "idx"], "left").join(noted, ["doc", "idx"], "left")
    controls = controls.withColumn("text", F.coalesce("text", F.lit("")))
    return controls.withColumn("structural", F.col("role").startswith("level") | ((F.col("role") == "section") & (F.col("text") == "")))


def provision_problems(controls: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc, identifier, problem): provisions of ``expected(doc, identifier)`` that lack, sections and subsections beside them, repeated identifiers, provisions without text."""
    n = controls.groupBy("doc", "identifier").agg(F.count(F.lit(1)).alias("n"), F.min((F.col("structural") | (F.col("text") != "")).cast("int")).alias("whole"), F.max((~F.col("role").startswith("level")).cast("int")).alias("counts"))
    both = n.join(expected.select("doc", "identifier", F.lit(True).alias("wanted")).distinct(), ["doc", "identifier"], "full")
    found = F.array(
        F.when(F.col("n").isNull(), "missing"), F.when(F.col("wanted").isNull() & (F.col("counts") == 1), "unexpected"), F.when(F.col("n") > 1, "repeated"), F.when(F.col("whole") == 0, "empty")
    )
    return both.select("doc", "identifier", F.explode(F.array_compact(found)).alias("problem"))


def assemble_principles(blocks: DataFrame, styles: list[Style], expected: DataFrame, reviewed: DataFrame, notes: DataFrame, contexts: DataFrame, **levels) -> tuple[DataFrame, DataFrame]:
    """(controls, problems) of documents that are loaded whole or not at all.

    Only documents that ``reviewed(doc, state)`` calls available are read; one with any problem (``provision_problems``) gives no controls.
    ``notes(identifier, scope_note)`` and ``contexts(identifier, uid, label)`` are rule tables that are laid beside the provisions.
    """
    fit = reviewed.where("state = 'available'").select("doc").distinct()
    changed = blocks.select("doc").distinct().join(fit, "doc", "left_anti").select("doc", F.lit(None).cast("string").alias("identifier"), F.lit("not the reviewed file").alias("problem"))
    made = assemble_levels(blocks.join(fit, "doc", "left_semi"), styles, sections_take_lines=True, **levels)
    problems = provision_problems(made, expected.join(fit, "doc", "left_semi")).unionByName(changed)
    beside = contexts.groupBy("identifier").agg(F.array_sort(F.collect_list(F.struct("uid", "label"))).alias("context"))
    controls = made.join(problems.select("doc").distinct(), "doc", "left_anti").join(notes, "identifier", "left").join(beside, "identifier", "left")
    return controls, problems


def cell_text(html: Column) -> Column:
    """Visible text of a cell: breaks and paragraphs part words, other tags don't; the usual entities are letters."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<(?:br|p)\b[^>]*>", " "), r"(?s)<[^>]*>", "")
    for name, letter in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(letter))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def table_rows(pages: DataFrame, levels: dict[str, str], groups: dict[str, str], key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(controls, problems): rows of the tables under known headings of ``pages(key, html)``, numbered within level and group.

    ``levels`` are headings (``h2``) and their codes, any other heading ends a level; a row of two cells names the group (``groups``: name and
    code) of itself and those after it; the last cell is the text. Controls are (key, pos, identifier, title, text, level); problems are
    (key, what): groups that ``groups`` doesn't know, and pairs of level and group code that a page lacks.
    """
    tag = r"(?is)<(h2|tr)\b[^>]*>(.*?)</\1\s*>"
    cells = F.transform(F.regexp_extract_all("inner", F.lit(r"(?is)<td\b[^>]*>(.*?)</td\s*>"), F.lit(1)), cell_text)
    found = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(tag), F.lit(0))).alias("pos", "b"))
    found = found.select(key, "pos", F.lower(F.regexp_extract("b", tag, 1)).alias("tag"), F.regexp_extract("b", tag, 2).alias("inner")).withColumn("cells", F.when(F.col("tag") == "tr", cells))
    entries = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    level = F.when(F.col("tag") == "h2", F.struct(F.try_element_at(entries(levels), cell_text(F.col("inner"))).alias("code")))
    rows = ordered_scan(found, [key], ["pos"], {"level": level}).where("tag = 'tr' and size(cells) > 0 and level.code is not null")
    rows = ordered_scan(rows, [key], ["pos"], {"title": F.when(F.size("cells") == 2, F.get("cells", F.lit(0)))})
    rows = rows.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("code", F.try_element_at(entries(groups), F.col("title")))
    known = numbered(rows.where("code is not null").withColumn("prefix", F.concat_ws("-", "level.code", "code")), [key, "prefix"], ["pos"])
    controls = known.select(key, "pos", F.concat("prefix", F.lit("-"), F.lpad(F.col("nth").cast("string"), F.greatest(F.lit(2), F.length(F.col("nth").cast("string"))), F.lit("0"))).alias("identifier"), "title", F.element_at("cells", -1).alias("text"), F.col("level.code").alias("level"))
    pairs = F.array(*[F.lit(f"{a}-{b}") for a in dict.fromkeys(levels.values()) for b in dict.fromkeys(groups.values())])
    missing = known.groupBy(key).agg(F.collect_set("prefix").alias("have")).select(key, F.explode(F.array_except(pairs, "have")).alias("p")).select(key, F.concat(F.lit("no rows: "), "p").alias("what"))
    unknown = rows.where("code is null").select(key, F.concat(F.lit("unknown group: "), "title").alias("what")).distinct()
    return controls, unknown.union(missing)


def heading_details(pages: DataFrame, section: str, key: str = "page_id") -> DataFrame:
    """(key, title, text): what stands under each ``h3`` while the ``h2`` above it begins with ``section``; paragraphs and items on lines of their own."""
    block = r"(?is)<(h[23])\b[^>]*>(.*?)</\1\s*>(.*?)(?=<h[23]\b|\z)"
    rows = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(block), F.lit(0))).alias("pos", "b"))
    rows = rows.select(key, "pos", F.lower(F.regexp_extract("b", block, 1)).alias("tag"), cell_text(F.regexp_extract("b", block, 2)).alias("title"), F.regexp_extract("b", block, 3).alias("body"))
    rows = ordered_scan(rows, [key], ["pos"], {"active": F.when(F.col("tag") == "h2", F.col("title").startswith(section))})
    lines = F.transform(F.split(F.regexp_replace("body", r"(?is)<(?:p|li|h4|br)\b[^>]*>", "\n"), "\n"), cell_text)
    return rows.where("tag = 'h3' and active").select(key, "title", F.array_join(F.filter(lines, lambda x: x != ""), "\n").alias("text"))
