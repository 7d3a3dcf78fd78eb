"""Text sources: styled blocks, HTML and lines to records; text mending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.scan import ordered_scan

SENTENCE = r"(?<!\b(?:e\.g|i\.e|etc|No|Fig|Sec|vol|cf))(?<=[.!?])\s+(?=[A-Z(])"
NORMATIVE = r"\b(SHALL|SHOULD|MUST|shall|should|must)\b"
PARAMETERS = [("period", r"(?i)\b\d+\s*(?:second|minute|hour|day|week|month|year)s?\b"), ("length", r"(?i)\b\d+\s*(?:bit|byte|character)s?\b"), ("bound", r"(?i)\b(?:at least|at most|no more than|no less than|minimum|maximum)\b"), ("rate", r"(?i)\bper (?:second|minute|hour|day)\b"), ("algorithm", r"\b(?:AES|SHA|RSA|ECDSA|HMAC|TDEA)\b"), ("entropy", r"(?i)\bentropy\b")]


def mend(text: Column) -> Column:
    """Hyphens of line breaks closed (but not ``- and``/``- or``), footnote digits taken off time units, blanks collapsed."""
    out = F.regexp_replace(text, r"(\p{L})-\s*\n\s*(?!and\b|or\b)(\p{Ll})", "$1$2")
    out = F.regexp_replace(out, r"\b(second|minute|hour|day|week|month|year)(s?)\d{1,2}\b", "$1$2")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def parameter_tags(text: Column, patterns: list[tuple[str, str]] = PARAMETERS) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns]))


def normative_sentences(sections: DataFrame, patterns: list[tuple[str, str]] = PARAMETERS, least: int = 45, most: int = 600, prefix: int = 140) -> DataFrame:
    """(doc, nth, sentence, parameters): normative sentences of ``sections(doc, text)`` that state a parameter, the first of each beginning."""
    s = sections.select("doc", F.posexplode(F.split(F.regexp_replace("text", r"\s+", " "), SENTENCE)).alias("nth", "sentence")).withColumn("sentence", F.trim("sentence"))
    s = s.where(F.length("sentence").between(least, most) & F.col("sentence").rlike(NORMATIVE)).withColumn("parameters", parameter_tags(F.col("sentence"), patterns)).where(F.size("parameters") > 0)
    first = Window.partitionBy("doc", F.substring("sentence", 1, prefix)).orderBy("nth")
    return s.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def html_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, tag, text) of every heading, paragraph, list item and cell, in order."""
    block = r"(?is)<(h[1-6]|p|li|td|th)\b[^>]*>(.*?)</\1>"
    rows = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(block), F.lit(0))).alias("pos", "b"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("b", block, 2), r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select(key, "pos", F.lower(F.regexp_extract("b", block, 1)).alias("tag"), text.alias("text"))


def html_statements(pages: DataFrame, key: str = "page_id", least: int = 40) -> DataFrame:
    """(key, pos, section, heading, text): paragraphs and items of some length under the numbered heading nearest above."""
    b = html_blocks(pages, key)
    head, first = F.col("tag").rlike("^h[1-6]$"), F.col("tag").isin("h1", "h2")
    # the count of h3 at the last h1 or h2 is taken off: it begins anew under each
    b = ordered_scan(b, [key], ["pos"], {"heading": F.when(head, F.col("text"))}, {"h1": first, "h3": F.col("tag") == "h3"})
    b = ordered_scan(b, [key], ["pos"], {"above": F.when(first, F.col("h3"))})
    b = b.withColumn("h2", F.col("h3") - F.coalesce("above", F.lit(0)))
    return b.where(F.col("tag").isin("p", "li") & (F.length("text") >= least)).select(key, "pos", F.concat_ws(".", F.col("h1").cast("string"), F.col("h2").cast("string")).alias("section"), "heading", "text")


def html_normative_statements(
    pages: DataFrame, key: str = "page_id", least: int = 40, prefix: int = 120, patterns: list[tuple[str, str]] = PARAMETERS, keyword: str = r"\b(SHALL|SHOULD)\b", volume: str | None = None
) -> DataFrame:
    """``html_statements`` that hold a keyword and state a parameter, with ``parameters``; of those that begin alike the first of a page, or of a ``volume`` (a column of ``pages``)."""
    s = html_statements(pages, key, least).where(F.col("text").rlike(keyword)).withColumn("parameters", parameter_tags(F.col("text"), patterns)).where(F.size("parameters") > 0)
    if volume is not None and volume != key:
        s = s.join(pages.select(key, volume).distinct(), key)
    # partial aggregation keeps the first of each beginning, however often a volume repeats it
    rest = [c for c in s.columns if c != volume or volume == key]
    first = s.groupBy(*([volume] if volume else [key]), F.substring("text", 1, prefix).alias("__b")).agg(F.min(F.struct(key, "pos")).alias("__f"))
    first = first.select(F.col(f"__f.{key}").alias(key), F.col("__f.pos").alias("pos"))
    return s.select(*rest).join(first, [key, "pos"], "left_semi")


def markdown_blocks(texts: DataFrame, stop: str = r"\n(?:#{1,6} |---)") -> DataFrame:
    """(doc, identifier, statement): ``#### ID`` blocks up to the first stop marker."""
    block = r"(?ms)^#### +(\S+)[^\n]*\n(.*?)(?=^#### |\z)"
    rows = texts.select("doc", F.explode(F.regexp_extract_all("text", F.lit(block), F.lit(0))).alias("b"))
    body = F.get(F.split(F.regexp_extract("b", block, 2), stop), F.lit(0))
    return rows.select("doc", F.regexp_extract("b", block, 1).alias("identifier"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("statement"))


def assemble_provisions(blocks: DataFrame, opens: Column, skip: Column | None = None) -> DataFrame:
    """(doc, nth, heading_idx, text, n_blocks) from styled ``blocks(doc, idx, style, text)``: a block that opens a provision takes those after it, a line each, until the next.

    One level; ``provisions.assemble_levels`` has parts, divisions, sections and subsections.
    """
    rows = blocks if skip is None else blocks.where(~skip)
    rows = ordered_scan(rows, ["doc"], ["idx"], sums={"nth": opens}).where("nth > 0")
    g = rows.groupBy("doc", "nth").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("s"))
    return g.select("doc", "nth", F.col("s")[0]["idx"].alias("heading_idx"), F.array_join("s.text", "\n").alias("text"), F.size("s").alias("n_blocks"))


def lettered_items(lines: DataFrame) -> DataFrame:
    """(section, item, text): a section's lead-in with each lettered item and its further lines; a section without letters is one record."""
    opens = F.col("text").rlike(r"^\([a-z]+\)")
    rows = lines.withColumn("item", F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy("section").orderBy("idx")))
    g = rows.groupBy("section", "item").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("s")).select("section", "item", F.array_join("s.text", " ").alias("text"))
    lead = g.where("item = 0").select("section", F.col("text").alias("lead"))
    n = g.groupBy("section").agg(F.max("item").alias("__m"))
    out = g.join(lead, "section", "left").join(n, "section").where("item > 0 or __m = 0")
    return out.select("section", "item", F.when(F.col("item") > 0, F.concat_ws(" ", "lead", "text")).otherwise(F.col("text")).alias("text"))


def labelled_blocks(lines: DataFrame, opener: str, confirm: str, labels: list[str], within: int = 4, ends: str | None = None, levels: str | None = None) -> DataFrame:
    """(doc, record, label, text): records begin at an opener that a confirming line follows soon; each label's lines up to the next.

    The lines between an opener and the first label belong to ``title``: a title that is wrapped is whole. With ``ends``, a pattern such as a
    mark at a title's end, the title ends at the first line that has it and further lines before a label go. With ``levels``, a pattern with
    one group, each record has a row ``levels`` too: what the pattern finds in the first label's lines, sorted and once each, else in the opener.
    """
    label = F.regexp_extract("text", "^(" + "|".join(labels) + r")\s*:", 1)
    rows = ordered_scan(lines, ["doc"], ["idx"], sums={"__p": F.lit(1)})
    # from below: where the next confirming line stands
    rows = ordered_scan(rows, ["doc"], [F.col("idx").desc()], {"__c": F.when(F.col("text").rlike(confirm), F.struct(F.col("__p").alias("p")))})
    sure = F.col("text").rlike(opener) & (F.col("__c.p") - F.col("__p")).between(1, within) & (label == "")
    rows = rows.withColumn("__o", F.coalesce(sure, F.lit(False)))
    named = F.when(F.col("__o"), F.lit("title")).when(label != "", label)
    if ends is not None:
        done = F.col("text").rlike(ends)
        rows = ordered_scan(rows, ["doc"], ["idx"], {"__l": named}, {"record": F.col("__o"), "__d": done & (label == "")}).where("record > 0")
        rows = ordered_scan(rows, ["doc"], ["idx"], {"__z": F.when(F.col("__o"), F.col("__d") - done.cast("int"))})
        rows = rows.where((F.col("__l") != "title") | (F.col("__d") - F.col("__z") == done.cast("int")) ).withColumnRenamed("__l", "label")
    else:
        rows = ordered_scan(rows, ["doc"], ["idx"], {"label": named}, {"record": F.col("__o")}).where("record > 0")
    g = rows.groupBy("doc", "record", "label").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("s"))
    out = g.select("doc", "record", "label", F.array_join("s.text", " ").alias("text"))
    if levels is None:
        return out
    each = out.where(F.col("label").isin("title", labels[0])).select("doc", "record", "label", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(levels), F.lit(1)))).alias("f"))
    best = each.where(F.size("f") > 0).groupBy("doc", "record").agg(F.max_by("f", F.col("label") == labels[0]).alias("f"))
    return out.union(best.select("doc", "record", F.lit("levels"), F.array_join("f", ",")))


def fold_tables(cells: DataFrame) -> DataFrame:
    """(table, row, text) of ``cells(table, row, col, val)``: empty columns go, first rows with an empty first cell are header, ``Column: value`` joined by semicolons."""
    c = cells.withColumn("val", F.trim(F.coalesce("val", F.lit(""))))
    used = c.where("val <> ''").select("table", "col").distinct()
    c = c.join(used, ["table", "col"], "left_semi")
    first = c.groupBy("table", "row").agg(F.min_by("val", "col").alias("first"))
    body = first.where("first <> '' and row > 0").groupBy("table").agg(F.min("row").alias("body"))
    c = c.join(body, "table")
    head = c.where("row < body").groupBy("table", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "val"))), lambda x: x["val"]), " ").alias("head"))
    rows = c.where("row >= body and val <> ''").join(head, ["table", "col"], "left").withColumn("t", F.concat_ws(": ", F.nullif(F.trim("head"), F.lit("")), "val"))
    return rows.groupBy("table", "row").agg(F.array_sort(F.collect_list(F.struct("col", "t"))).alias("s")).select("table", "row", F.array_join("s.t", "; ").alias("text"))


