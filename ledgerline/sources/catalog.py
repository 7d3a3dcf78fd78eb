"""Catalogue sources: nested JSON to rows, parameters, statements, profiles, reference columns."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.common import materialise
from ledgerline.operators.scan import numbered, ordered_scan


def _fields(kind: T.DataType) -> dict:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}


def flatten_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, parent_id, depth, group_path, control as JSON) of every control in a catalogue file, however deep groups and controls are nested."""
    root = spark.read.json(path, multiLine=True).select("catalog.*")
    empty = F.array().cast("array<string>")
    out: list[DataFrame] = []

    def controls(df: DataFrame, field: str, parent: Column, depth: int) -> None:
        if field not in df.columns:
            return
        c = df.select(F.col("group_path"), parent.alias("parent_id"), F.explode(field).alias("c"))
        names = _fields(c.schema["c"].dataType)
        out.append(c.select(F.col("c.id").alias("id"), (F.col("c.title") if "title" in names else F.lit(None).cast("string")).alias("title"), "parent_id", F.lit(depth).alias("depth"), "group_path", F.to_json("c").alias("control")))
        if "controls" in names:
            controls(c.select("group_path", F.col("c.id").alias("id"), F.col("c.controls").alias("controls")), "controls", F.col("id"), depth + 1)

    def groups(df: DataFrame) -> None:
        controls(df, "controls", F.lit(None).cast("string"), 0)
        if "groups" in df.columns:
            g = df.select("group_path", F.explode("groups").alias("g"))
            names = _fields(g.schema["g"].dataType)
            name = F.coalesce(*[F.col(f"g.{n}") for n in ("title", "id") if n in names])
            groups(g.select(F.concat("group_path", F.array(name)).alias("group_path"), *[F.col(f"g.{n}").alias(n) for n in ("controls", "groups") if n in names]))

    groups(root.withColumn("group_path", empty))
    return reduce(DataFrame.union, out)


PLACEHOLDER = r"\{\{\s*insert:\s*param,\s*([^}\s]+)\s*\}\}"


def resolve_params(text: Column, params: Column, passes: int = 5) -> Column:
    """``{{ insert: param, id }}`` replaced by the label of ``params`` (a map), all at once, and again for what labels insert; an unknown id becomes ``[id]``."""

    def once(t: Column) -> Column:
        said = F.transform(F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(1)), lambda p: F.coalesce(F.try_element_at(params, p), F.concat(F.lit("["), p, F.lit("]"))))
        return F.array_join(F.zip_with(F.split(t, PLACEHOLDER, -1), said, lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")

    out = text
    for _ in range(passes):
        out = F.get(F.transform(F.array(out), once), 0)
    return out


def preferred_label(labels: Column, identifier: Column) -> tuple[Column, Column]:
    """(the shortest label, first by letter at equal length, or the identifier with its leading letters in capitals; the other labels)."""
    ranked = F.array_sort(F.transform(F.array_distinct(labels), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    prefix = F.regexp_extract(identifier, "^([a-z]+)[-_]", 1)
    best = F.coalesce(F.get(ranked, F.lit(0))["x"], F.concat(F.upper(prefix), F.substring(identifier, F.length(prefix) + 1, F.length(identifier))))
    return best, F.array_except(F.coalesce(labels, F.array().cast("array<string>")), F.array(best))


def real_title(title: Column, identifier: Column, label: Column) -> Column:
    """The title, or null where it only restates the identifier."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^control\s*:?\s*|[^a-z0-9]", "")
    return F.when((plain(title) != "") & (plain(title) != plain(identifier)) & (plain(title) != plain(label)), F.trim(title))


def published_procedures(parts: DataFrame) -> DataFrame:
    """(control_uid, kind, text, provenance) from ``parts(control_uid, name, method, prose, ord)``: objectives as they are, methods with their name before them."""
    text = F.when(F.col("name") == "assessment-method", F.concat(F.initcap("method"), F.lit(": "), "prose")).otherwise(F.col("prose"))
    rows = parts.where(F.col("name").isin("assessment-objective", "assessment-method")).select("control_uid", F.lit("test").alias("kind"), F.trim(text).alias("text"), F.lit("published").alias("provenance"), "ord")
    return rows.where("text is not null and text <> ''")


def _items(node: str, field: str) -> Column:
    """The elements of a field that is an array, with their places; no rows if there is none."""
    return F.posexplode(F.try_variant_get(F.col(node), f"$.{field}", "array<variant>")).alias("i", "child")


def _text_of(node: str, field: str) -> Column:
    return F.try_variant_get(F.col(node), f"$.{field}", "string")


def walk_catalogs(catalogs: DataFrame) -> DataFrame:
    """(doc, place, id, parent_id, depth, group_path, control VARIANT) of every control in ``catalogs(doc, json)``, however deep groups and controls are nested.

    No schema is read off the files: a catalogue is a variant that is walked a level a round, all documents at once, until no node has
    children. ``place`` orders a document's controls as one reads them, groups of a node before its controls. The parent is the control
    or group above. Texts that aren't JSON, or no catalogue, have no controls.
    """
    none = F.lit(None).cast("string")
    root = catalogs.select("doc", F.try_variant_get(F.try_parse_json("json"), "$.catalog", "variant").alias("node"))
    ways = F.array().cast("array<string>"), F.array().cast("array<int>")
    level = root.where("node is not null").select("doc", "node", none.alias("parent_id"), F.lit(-1).alias("depth"), ways[0].alias("group_path"), ways[1].alias("place"), F.lit(False).alias("is_control"))

    def kids(field: str, if_: Column) -> Column:
        some = F.when(if_, F.try_variant_get(F.col("node"), f"$.{field}", "array<variant>"))
        listed = F.transform(some, lambda c, i: F.struct(F.lit(field).alias("field"), i.alias("i"), c.alias("child")))
        return F.coalesce(listed, F.array().cast("array<struct<field:string,i:int,child:variant>>"))

    found = []
    while True:
        level = materialise(level)
        if level.isEmpty():
            break
        found.append(level.where("is_control"))
        # groups and controls of a node in one pass, so the number of tasks stays as it is
        below = F.posexplode(F.concat(kids("groups", ~F.col("is_control")), kids("controls", F.lit(True)))).alias("__n", "kid")
        level = level.select("doc", "node", "depth", "group_path", "place", F.col("is_control").alias("inner"), below)
        controls, child, i = F.col("kid.field") == "controls", "kid.child", F.col("kid.i")
        way = F.when(F.col("inner"), F.array(i)).otherwise(F.array(F.when(controls, 1).otherwise(0), i))
        level = level.select(
            "doc", F.col(child).alias("node"), F.when(controls, _text_of("node", "id")).alias("parent_id"), (F.col("depth") + controls.cast("int")).alias("depth"),
            F.when(controls, F.col("group_path")).otherwise(F.concat("group_path", F.array(F.coalesce(_text_of(child, "title"), F.lit(""))))).alias("group_path"), F.concat("place", way).alias("place"), controls.alias("is_control"),
        )
    if not found:
        found = [level]
    return reduce(DataFrame.union, found).select("doc", "place", _text_of("node", "id").alias("id"), "parent_id", "depth", "group_path", F.col("node").alias("control"))


def parameter_labels(controls: DataFrame) -> DataFrame:
    """(doc, place, params MAP): what stands for each parameter of a control: its label, its choices, its values, or its id; of repeated ids the last."""
    rows = controls.select("doc", "place", _items("control", "params")).select("doc", "place", "i", F.col("child").alias("p"), _text_of("child", "id").alias("pid")).where("pid <> ''")
    choice = F.try_variant_get(F.col("p"), "$.select.choice", "array<variant>")
    named = F.transform(choice, lambda c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")).otherwise(F.coalesce(F.nullif(F.try_variant_get(c, "$.value", "string"), F.lit("")), F.try_variant_get(c, "$.prose", "string"))))
    named = F.filter(named, lambda x: x.isNotNull() & (x != ""))
    many = F.try_variant_get(F.col("p"), "$.values", "array<string>")
    framed = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    label = F.when(_text_of("p", "label") != "", framed(_text_of("p", "label")))
    label = label.when(F.try_variant_get(F.col("p"), "$.select", "variant").isNotNull(), F.when(F.size(named) > 0, framed(F.array_join(named, " or "))).otherwise("[selection]"))
    label = label.when(F.size(many) > 0, F.array_join(many, ", ")).when(many.isNull() & (_text_of("p", "values") != ""), _text_of("p", "values")).otherwise(framed(F.col("pid")))
    last = rows.groupBy("doc", "place", "pid").agg(F.max_by(label, "i").alias("label"))
    return last.groupBy("doc", "place").agg(F.map_from_entries(F.collect_list(F.struct("pid", "label"))).alias("params"))


def walk_parts(controls: DataFrame) -> DataFrame:
    """(doc, place, name, path, label, prose) of every part of every control that has prose; ``name`` is that of the outermost part, ``path`` where it stands."""
    label = F.get(F.filter(F.try_variant_get(F.col("child"), "$.props", "array<variant>"), lambda p: F.try_variant_get(p, "$.name", "string") == "label"), 0)
    said = lambda name, path: ("doc", "place", name.alias("name"), path.alias("path"), F.trim(F.try_variant_get(label, "$.value", "string")).alias("label"), F.trim(_text_of("child", "prose")).alias("prose"), F.col("child").alias("node"))
    level = controls.select("doc", "place", _items("control", "parts")).select(*said(_text_of("child", "name"), F.array("i")))
    found = []
    while True:
        level = materialise(level)
        found.append(level)
        if level.isEmpty():
            return reduce(DataFrame.union, found).where("prose <> ''").drop("node")
        level = level.select("doc", "place", "name", "path", _items("node", "parts")).select(*said(F.col("name"), F.concat("path", F.array("i"))))


def catalog_controls(catalogs: DataFrame) -> DataFrame:
    """(doc, place, id, identifier, alternates, title, text, guidance, depth, parent_id, section_ref, class) of ``catalogs(doc, json)``.

    Statements and guidance are their parts depth first, two blanks a level and the label before the prose, with the control's own
    parameters put in; parameters reach their control by a join, so a catalogue of any size is never read by one task after the parse.
    """
    controls = materialise(walk_catalogs(catalogs))
    params = parameter_labels(controls)
    parts = walk_parts(controls).where("name in ('statement', 'guidance')")
    line = F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.concat_ws(" ", F.nullif("label", F.lit("")), "prose"))
    texts = parts.groupBy("doc", "place", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("t"))
    texts = texts.groupBy("doc", "place").agg(*[F.max(F.when(F.col("name") == n, F.col("t"))).alias(n) for n in ("statement", "guidance")])
    props = F.try_variant_get(F.col("control"), "$.props", "array<variant>")
    labels = F.transform(F.filter(props, lambda p: F.try_variant_get(p, "$.name", "string") == "label"), lambda p: F.try_variant_get(p, "$.value", "string"))
    labels = F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))
    out = controls.join(params, ["doc", "place"], "left").join(texts, ["doc", "place"], "left").withColumn("__labels", labels)
    best, others = preferred_label(F.col("__labels"), F.col("id"))
    put = lambda c: F.trim(resolve_params(F.col(c), F.coalesce("params", F.create_map().cast("map<string,string>"))))
    shown = F.array_join(F.filter("group_path", lambda g: g != ""), " > ")
    return out.withColumn("identifier", F.coalesce(best, F.lit(""))).select(
        "doc", "place", "id", "identifier", others.alias("alternates"), real_title(_text_of("control", "title"), F.col("id"), F.col("identifier")).alias("title"),
        F.coalesce(put("statement"), F.lit("")).alias("text"), F.nullif(put("guidance"), F.lit("")).alias("guidance"), "depth", "parent_id", F.nullif(shown, F.lit("")).alias("section_ref"), _text_of("control", "class").alias("class"),
    )


def part_text(parts: DataFrame) -> DataFrame:
    """(control_uid, text) of ``parts(control_uid, path ARRAY<INT>, label, prose)``: depth first, two blanks a level."""
    line = F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.concat_ws(" ", "label", "prose"))
    listed = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    return parts.groupBy("control_uid").agg(listed.alias("s")).select("control_uid", F.array_join("s.line", "\n").alias("text"))


def link_parents(controls: DataFrame) -> DataFrame:
    """``controls(uid, source_id, source_parent_id)`` with ``parent_uid``."""
    ids = controls.select(F.col("source_id").alias("source_parent_id"), F.col("uid").alias("parent_uid"))
    return controls.join(ids, "source_parent_id", "left")


def carry_props(props: Column, names: list[str]) -> Column:
    """Map of the named properties to their values, in order."""
    wanted = F.filter(props, lambda p: p["name"].isin(names))
    keys = F.array_distinct(F.transform(wanted, lambda p: p["name"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(wanted, lambda p: p["name"] == k), lambda p: p["value"]))))


def wide_stages(rows: DataFrame, stages: list[str]) -> DataFrame:
    """(uid, text, tags): one text from a wide row of maturity stages, in the order of the stages, empty ones left out."""
    parts = [F.when(F.trim(F.col(s)) != "", F.concat(F.lit(f"{s}: "), F.trim(F.col(s)))) for s in stages]
    tags = F.map_filter(F.create_map(*[x for s in stages for x in (F.lit(s), F.trim(F.col(s)))]), lambda k, v: v.isNotNull() & (v != ""))
    return rows.select("uid", F.concat_ws(" ", *parts).alias("text"), tags.alias("tags"))


def numbering_gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, number): numbers up to a group's largest that no row has."""
    span = rows.groupBy(group).agg(F.max(number).alias("__m")).select(group, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__m").cast("bigint"))).alias(number))
    return span.join(rows.select(group, F.col(number).cast("bigint").alias(number)).distinct(), [group, number], "left_anti")


def positional_ids(rows: DataFrame, parent: str, order: list[str], cell: str | None = None) -> DataFrame:
    """``rows`` with ``nth`` and ``identifier`` (parent.nth), and ``renumbered`` where the cell says otherwise."""
    out = numbered(rows, [parent], order)
    out = out.withColumn("identifier", F.concat_ws(".", F.col(parent).cast("string"), F.col("nth").cast("string")))
    return out if cell is None else out.withColumn("renumbered", ~F.col(cell).cast("string").eqNullSafe(F.col("identifier")))


def forward_fill(rows: DataFrame, document: str, order: str, columns: list[str]) -> DataFrame:
    """Blank cells take the nearest value above them in their document."""
    filled = ordered_scan(rows, [document], [order], {f"__{c}": F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns})
    return filled.select(*[F.col(f"__{c}").alias(c) if c in columns else c for c in rows.columns])


def mapping_cells(rows: DataFrame, cell: str, pattern: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_uid, target_uid) for every identifier in a mapping cell that ``targets(identifier, uid)`` knows, once each; and the rest."""
    ids = rows.select(F.col("uid").alias("source_uid"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(cell), F.lit("")), F.lit(pattern), F.lit(0)))).alias("identifier"))
    known = targets.select("identifier", F.col("uid").alias("target_uid"))
    return ids.join(known, "identifier").select("source_uid", "target_uid"), ids.join(known, "identifier", "left_anti")


#: Bytes up to which a file is read as one value.
WHOLE = 32 << 20


def file_digests(spark: SparkSession, path: str, files: str = "*", whole: int = WHOLE) -> DataFrame:
    """(filename, sha256) of the files of any folder under ``path`` whose name fits ``files``.

    Files of at most ``whole`` bytes are read by tasks, each as one value. A larger one may be longer than a value can be or than a task
    has room for, and its digest can't be put together from parts, so it runs through a stream of the driver, which holds a few KB of it; eight run at once.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("filename")
    small = found.where(F.col("length") <= whole).select(name, F.sha2("content", 256).alias("sha256"))
    paths = [(r.path, r.filename) for r in found.where(F.col("length") > whole).select("path", name).collect()]  # names only, no contents
    if not paths:
        return small
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def digest(at: str) -> str:
        where = jvm.org.apache.hadoop.fs.Path(at)
        stream = where.getFileSystem(conf).open(where)
        try:
            return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    with ThreadPoolExecutor(8) as pool:
        rows = list(zip([n for _, n in paths], pool.map(digest, [p for p, _ in paths]), strict=True))
    return small.union(spark.createDataFrame(rows, "filename string, sha256 string"))


def source_audit(spark: SparkSession, path: str, manifest: DataFrame, files: str = "*") -> DataFrame:
    """(filename, state, known_as): available, changed or missing against ``manifest(filename, sha256)``, or unlisted.

    An unlisted file whose digest is that of a missing one is ``known_as`` it. Files of any folder under ``path`` whose name fits ``files`` are read.
    """
    found = materialise(file_digests(spark, path, files).withColumnRenamed("sha256", "__h"))
    out = manifest.select("filename", "sha256").join(found, "filename", "full")
    state = F.when(F.col("__h").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("__h") == F.col("sha256"), "available").otherwise("changed")
    out = out.withColumn("state", state)
    lost = out.where("state = 'missing'").groupBy(F.col("sha256").alias("__h")).agg(F.min("filename").alias("known_as")).withColumn("state", F.lit("unlisted"))
    return out.join(lost, ["__h", "state"], "left").select("filename", "state", "known_as")


def threat_graph(techniques: DataFrame, mitigations: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """First row of each key; ``mitigates`` edges whose ends are known; and the edges dropped."""
    first = lambda df, k: df.withColumn("__n", F.row_number().over(Window.partitionBy(k).orderBy("load_seq"))).where("__n = 1").drop("__n")
    t, m = first(techniques, "technique_id"), first(mitigations, "mitigation_id")
    e = edges.where("kind = 'mitigates'").select("mitigation_id", "technique_id").distinct()
    good = e.join(t.select("technique_id"), "technique_id", "left_semi").join(m.select("mitigation_id"), "mitigation_id", "left_semi")
    return t, m, good, e.join(good, ["mitigation_id", "technique_id"], "left_anti")


def symmetric_related(library: DataFrame) -> DataFrame:
    """(id, related) both ways, once each, from ``library(id, related ARRAY)``."""
    e = library.select("id", F.explode("related").alias("related"))
    return e.union(e.select("related", "id")).where("id <> related").distinct()
