"""Registered queries of catalogues, ordered documents, reports of a corpus and of its topics, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.fixtures import frame, text_of
from ledgerline.operators import corpus as C
from ledgerline.operators import graph as G
from ledgerline.operators import reports as R
from ledgerline.operators import thresholds as T
from ledgerline.operators.common import materialise
from ledgerline.plans.graph_queries import _REL
from ledgerline.plans.report_queries import _E, _entries
from ledgerline.sources import catalog, hierarchies, provisions, texts
from ledgerline.sources.provisions import Style

_V = "varchar(20)"
# three long documents of styled blocks, out of line items
_BLOCKS = f"""select l_orderkey % 3 as doc, l_orderkey * 10 + l_linenumber as idx,
  case when k = 0 then 'part' when k = 1 then 'division' when k <= 4 then 'section' when k <= 9 then 'subsection' when k <= 14 then 'paragraph' when k = 15 then 'note' when k = 16 then 'toc' else 'penalty' end as style,
  case when k = 0 then concat('Part ', cast(p as {_V}), ' — About ', cast(p as {_V})) when k = 1 then concat('Division ', cast(p % 9 as {_V}), ' — Some') when k <= 3 then concat(cast(p as {_V}), ' Title ', cast(p as {_V})) when k = 4 then 'Schedule'
    when k <= 8 then concat('(', cast(l_linenumber as {_V}), ') must do ', cast(p as {_V}), '.') when k = 9 then concat('Plain ', cast(p as {_V}), '.') when k <= 14 then concat('(a) item ', cast(p as {_V}), ';') else concat('units ', cast(p as {_V})) end as text
  from (select l_orderkey, l_linenumber, min(l_partkey) as p, (min(l_partkey) + l_linenumber) % 24 as k from lineitem group by l_orderkey, l_linenumber) as b"""
_STYLES = [
    Style("^toc", "skip"), Style("^part", "level0", r"^(Part\s+[0-9]+)\s*[—-]?\s*(.*)$"), Style("^division", "level1", r"^(Division\s+[0-9]+)\s*[—-]?\s*(.*)$"), Style("^section", "section", r"^([0-9]+[A-Z]*)\s+(.*)$", "s {number}"),
    Style("^subsection", "subsection", r"^\(([0-9]+)\)\s*(.*)$", "s {section}({number})"), Style("^(paragraph|penalty)", "more"), Style("^note", "note"),
]
# four long documents of lines, out of orders
_RECORDS = f"""select o_custkey % 4 as doc, o_orderkey as idx, case (o_custkey * 7 + o_orderkey) % 8 when 0 then concat('1.', cast(o_orderkey as {_V}), ' (L3) Ensure that', case when o_orderkey % 3 = 0 then ' (Manual)' else '' end)
  when 1 then 'Profile:' when 2 then concat('for (L', substring(o_orderpriority, 1, 1), ') and (L1)') when 3 then 'Description:' when 4 then 'more (Manual)' else o_orderpriority end as text from orders"""
# five pages of tables under headings, out of parts
_PIECES = f"""select p_partkey % 5 as page_id, p_partkey as idx, p_size % 6 as k, case p_partkey % 4 when 0 then 'Patch' when 1 then 'Back up' when 2 then 'Odd' else 'Lock' end as strategy, p_name as name from part"""
_PIECE = f"""case k when 0 then '<h2>Level <b>One</b></h2>' when 1 then '<h2>Level Two</h2>' when 2 then '<h2>Other</h2>' when 3 then concat('<tr><td> ', strategy, '</td><td>', name, '</td></tr>') else concat('<tr><td>', name, '<br>', cast(idx as {_V}), '</td></tr>') end"""


def _of(spark, d, sql, table):
    return spark.sql(sql.replace(f"from {table}", "from {t}"), t=frame(spark, d, table))


def provision_levels(spark, d):
    out = provisions.assemble_levels(_of(spark, d, _BLOCKS, "lineitem"), _STYLES, section_depth=2)
    return out.select("doc", "idx", "identifier", "title", F.col("depth").cast("long").alias("depth"), "parent", "section_ref", "text", F.coalesce(F.size("notes"), F.lit(0)).cast("long").alias("n_notes"), "structural")


def labelled_records(spark, d):
    lines = _of(spark, d, _RECORDS, "orders")
    return texts.labelled_blocks(lines, r"^\d+\.\d+ ", "^Profile:", ["Profile", "Description"], ends=r"\((Automated|Manual)\)$", levels=r"\((L\d)\)")


def table_row_controls(spark, d):
    pieces = _of(spark, d, _PIECES, "part").withColumn("piece", F.expr(_PIECE))
    pages = pieces.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "piece"))), lambda x: x["piece"]), "\n").alias("html"))
    controls, problems = provisions.table_rows(pages, {"Level One": "L1", "Level Two": "L2"}, {"Patch": "P", "Back up": "B", "Lock": "L"})
    return controls.select("page_id", "identifier", "title", "text", "level").union(problems.select("page_id", F.lit(None), F.lit(None), "what", F.lit(None)))


def catalog_controls(spark, d):
    """A catalogue of nested JSON for each customer, with its orders as controls within its own."""
    c, o = frame(spark, d, "customer"), frame(spark, d, "orders")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    k, n = F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string")
    one = F.struct(text("o-", n).alias("id"), text("Control: o-", n).alias("title"), F.array(F.struct(F.lit("statement").alias("name"), F.col("o_orderpriority").alias("prose"))).alias("parts"))
    orders = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(one).alias("controls"))
    prop = lambda name, v: F.struct(F.lit(name).alias("name"), v.alias("value"))
    item = F.struct(F.lit("item").alias("name"), F.array(prop("label", F.lit("a."))).alias("props"), F.lit("for {{ insert: param, o }}").alias("prose"))
    parts = F.array(
        F.struct(F.lit("statement").alias("name"), text("Keep {{ insert: param, c-", k, "_a }}:").alias("prose"), F.array(item).alias("parts")),
        F.struct(F.lit("guidance").alias("name"), text("See ", F.col("c_mktsegment")).alias("prose"), F.lit(None).cast("array<struct<name:string,props:array<struct<name:string,value:string>>,prose:string>>").alias("parts")),
    )
    choice = F.struct(F.array(F.lit("x"), F.col("c_mktsegment")).alias("choice"))
    params = F.array(
        F.struct(text("c-", k, "_a").alias("id"), text("each {{ insert: param, c-", k, "_b }}").alias("label"), F.lit(None).cast("struct<choice:array<string>>").alias("select")),
        F.struct(text("c-", k, "_b").alias("id"), F.lit(None).cast("string").alias("label"), choice.alias("select")),
    )
    control = F.struct(text("c-", k).alias("id"), F.col("c_name").alias("title"), F.array(prop("label", text("C-00", k)), prop("label", text("C-", k))).alias("props"), params.alias("params"), parts.alias("parts"), F.col("controls").alias("controls"))
    odd = F.col("c_custkey") % 2 == 1
    inner = F.when(odd, F.array(F.struct(F.col("c_mktsegment").alias("title"), F.array(control).alias("controls"))))
    group = F.struct(text("n", F.col("c_nationkey").cast("string")).alias("id"), text("Nation ", F.col("c_nationkey").cast("string")).alias("title"), inner.alias("groups"), F.when(~odd, F.array(control)).alias("controls"))
    rows = c.join(orders, "c_custkey", "left").select(F.col("c_custkey").alias("doc"), F.to_json(F.struct(F.struct(F.array(group).alias("groups")).alias("catalog"))).alias("json"))
    out = catalog.catalog_controls(rows)
    return out.select("doc", "id", "identifier", F.array_join("alternates", "|").alias("alternates"), "title", "text", "guidance", F.col("depth").cast("long").alias("depth"), "parent_id", "section_ref")


_TOPICS = [("t1", "licence", "(?i)licens"), ("t2", "the", r"\bthe\b"), ("t3", "long", r"[a-z]{16,}"), ("t4", "digits", "[0-9]{4,}"), ("t5", "shouting", r"\b[A-Z]{8,}!!"), ("t6", "a thorn", "þþþþ")]
_KNOWN = ["licence", "the", "long", "digits", "backups"]


def _topics(spark, d):
    return R.topic_report(R.assessable_entries(_entries(spark, d)), _TOPICS, _KNOWN)


def topic_report(spark, d):
    return _topics(spark, d).topics


def topic_families(spark, d):
    return _topics(spark, d).families


def topic_samples(spark, d):
    return _topics(spark, d).samples


def topic_ratings(spark, d):
    """How many topics have each rating, and where names and patterns are out of step."""
    report = _topics(spark, d)
    return report.ratings.select(F.concat(F.lit("band "), F.col("band").cast("string")).alias("what"), "n").union(report.problems.select(F.concat_ws(": ", "problem", "topic"), F.lit(1).cast("long")))


_SUMMED = f"select *, case when tier = 2 then 'r1' end as revision, case when tier = 1 then 'full' else 'part' end as fidelity, case when cast(substring(framework_key, 4) as int) % 4 = 1 then 'not public' end as reason from ({text_of('frameworks')}) as f"


def load_summary(spark, d):
    frameworks = frame(spark, d, "frameworks").withColumn("revision", F.when(F.col("tier") == 2, "r1")).withColumn("fidelity", F.when(F.col("tier") == 1, "full").otherwise("part"))
    number = F.substring("framework_key", 4, 10).cast("int")
    controls = frame(spark, d, "controls").where(number % 5 != 2)
    absent = frameworks.where(number % 4 == 1).select("framework_key", F.lit("not public").alias("reason"))
    statements = frame(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "derived").otherwise("published").alias("provenance"))
    return C.load_summary(frameworks, controls, frame(spark, d, "links"), statements, absent, {"details": frame(spark, d, "part"), "techniques": frame(spark, d, "supplier")})


def source_audit(spark, d):
    """The given files themselves against a manifest that knows some of them, one under another name and one with another digest."""
    files = materialise(catalog.file_digests(spark, d, "*.parquet"))
    first = F.substring("filename", 1, 1)
    manifest = files.where(first != "p").select(F.when(first == "r", F.concat(F.lit("old-"), "filename")).otherwise(F.col("filename")).alias("filename"), F.when(first == "n", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    return catalog.source_audit(spark, d, manifest, "*.parquet")


def lineage(spark, d):
    uids = frame(spark, d, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 10).cast("string"), F.lit(":"), F.col("p_partkey").cast("string")).alias("uid"))
    uids = uids.union(frame(spark, d, "nation").select(F.concat(F.lit("x:"), F.col("n_nationkey").cast("string"))))
    out = G.lineage(uids, frame(spark, d, "links"), _of(spark, d, _LINKED, "region"))
    return out.select("uid", "provenance", F.col("nth").cast("long").alias("nth"), "other_uid", "kind", "outward", "load_seq", "note")


_LINKED = f"select concat('s', cast(r_regionkey as {_V})) as framework_key, concat('S', cast(r_regionkey as {_V})) as short_name, 5 - r_regionkey as tier, r_regionkey % 2 as jurisdiction, 0 as intra_order from region"


def stated_thresholds(spark, d):
    """Of each requirement the first half as a title, the rest as text: a figure on either side counts."""
    rows = frame(spark, d, "requirements").select("text").distinct()
    half = F.expr("instr(text, '. ')")
    rows = rows.select(F.col("text").alias("uid"), F.when(half > 0, F.expr("substring(text, 1, instr(text, '. ') - 1)")).alias("title"), F.when(half > 0, F.expr("substring(text, instr(text, '. ') + 2)")).otherwise(F.col("text")).alias("text"))
    return T.stated_by(rows).select("uid", F.col("nth").cast("long").alias("nth"), F.col("value").cast("double").alias("value"), "unit", "bound")


def threat_graph(spark, d):
    """Suppliers as techniques and parts as mitigations, each twice, and edges of which some have no end."""
    s, p, e = frame(spark, d, "supplier"), frame(spark, d, "part"), frame(spark, d, "lineitem")
    twice = lambda df, key, name: df.select(F.col(key).alias(name), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).withColumn("load_seq", F.col(name) * 2 + F.when(F.col("copy") == 1, 1).otherwise(0))
    techniques = twice(s.where("s_suppkey % 4 <> 0"), "s_suppkey", "technique_id")
    mitigations = twice(p.where("p_partkey % 5 <> 0"), "p_partkey", "mitigation_id")
    edges = e.select(F.when(F.col("l_linenumber") % 3 == 0, "uses").otherwise("mitigates").alias("kind"), F.col("l_partkey").alias("mitigation_id"), F.col("l_suppkey").alias("technique_id"))
    t, m, good, dropped = catalog.threat_graph(techniques, mitigations, edges)
    row = lambda df, part, a, b: df.select(F.lit(part).alias("part"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    out = row(t, "technique", F.col("technique_id"), F.col("copy")).union(row(m, "mitigation", F.col("mitigation_id"), F.col("copy")))
    return out.union(row(good, "edge", F.col("mitigation_id"), F.col("technique_id"))).union(row(dropped, "dropped", F.col("mitigation_id"), F.col("technique_id")))


def markdown_policy_blocks(spark, d):
    block = F.concat(F.lit("#### ID-"), F.col("p_partkey").cast("string"), F.lit(" title\n"), "p_name", F.lit("\n  "), "p_type", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n---\n"), "p_brand")).otherwise(F.lit("\n")))
    files = frame(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))
    return texts.markdown_blocks(files)


def parameter_references(spark, d):
    """Parts as commands whose parameters are the words of their type; a third of the reference texts has them all, a third the first one only."""
    p = frame(spark, d, "part")
    calls = p.select(F.col("p_partkey").cast("string").alias("command"), F.split(F.lower("p_type"), " ").alias("parameters"))
    references = p.select(F.col("p_partkey").cast("string").alias("command"), F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("-"), F.replace("p_type", F.lit(" "), F.when(F.col("p_size") % 3 == 1, " -").otherwise(" "))))).alias("text"))
    return R.parameter_reference_check(calls, references)


_GROUPED = f"""select concat('g', cast(l_suppkey % 4 as {_V})) as framework_key, case when l_suppkey % 5 = 0 then '' else concat('V', cast(l_suppkey % 5 as {_V})) end as group_key, case when k % 3 = 0 then ' ' else cast(k % 3 as {_V}) end as section_number,
  concat('About ', cast(p as {_V})) as section_title, case k when 0 then 'Must' when 1 then ' should not ' when 2 then '' when 3 then 'may' else 'never' end as keyword, case when p % 9 = 0 then ' ' else concat('Do ', cast(p as {_V})) end as text, p, l_orderkey * 10 + l_linenumber as load_seq
  from (select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey, min(l_partkey) as p, l_linenumber % 5 as k from lineitem group by l_orderkey, l_linenumber) as b"""


def statement_controls(spark, d):
    rows = _of(spark, d, _GROUPED, "lineitem").withColumn("parameters", F.when(F.col("p") % 2 == 0, F.array(F.lit("period"), F.concat(F.lit("p"), (F.col("p") % 3).cast("string")))))
    groups = rows.select("framework_key", "group_key", F.concat(F.lit("Volume "), "group_key").alias("title")).distinct().union(spark.createDataFrame([("none", "X", " ")], "framework_key string, group_key string, title string"))
    controls, counts, warnings = hierarchies.statement_controls(groups, rows)
    out = controls.withColumn("parameters", F.array_join("parameters", "|")).withColumn("depth", F.col("depth").cast("long"))
    rest = [F.lit(None)] * 6
    out = out.select("framework_key", "identifier", "title", "depth", "parent", "section_ref", "text", "obligation", "keyword", "parameters", "structural")
    out = out.union(counts.select("framework_key", "name", "kind", "n", *rest, F.lit(None)))
    return out.union(warnings.select("framework_key", "warning", F.lit("warning"), F.lit(None), *rest, F.lit(None)))


_PRACTICED = f"""select concat('m', cast(p_size % 2 as {_V})) as framework_key, concat('D', cast(p_partkey % 5 as {_V})) as domain, p_partkey % 3 as objective_number, concat('Aim ', p_brand) as objective, concat('D', cast(p_partkey % 5 as {_V}), '-', cast(p_partkey % 3 as {_V}), cast(p_partkey % 400 as {_V})) as identifier, p_name as text, p_size % 4 as mil, p_partkey as load_seq from part"""


def practice_hierarchy(spark, d):
    rows = _of(spark, d, _PRACTICED, "part")
    stated = spark.createDataFrame([("m0", 7), ("m1", 0), ("m2", 5)], "framework_key string, stated long")
    controls, warnings = hierarchies.practice_controls(rows, stated)
    out = controls.select("framework_key", "identifier", "title", F.col("depth").cast("long").alias("depth"), "parent", "section_ref", "text", "level", "structural")
    return out.union(warnings.select("framework_key", F.lit("warning"), F.regexp_replace("warning", r"\d+ of", "some of"), *[F.lit(None)] * 6))


_TARGETS = f"select concat('t', cast(p_partkey as {_V})) as uid, concat('Guide > ', p_brand, ' > ', p_type) as section_ref, p_name as text from part"
_ALIASES = [("Brand x", ["brand#11", "brand#22"], ["a"], []), ("Brand y", ["Brand#33"], [], ["e", "zz"]), ("Brand z", ["brand#44"], [], [])]


def bridge_by_strategy(spark, d):
    """Suppliers name strategies: brands that are headings, others that an alias reads, others that nothing does."""
    aliases = spark.createDataFrame(_ALIASES, "strategy string, sections array<string>, requires array<string>, excludes array<string>")
    k = F.col("s_suppkey")
    named = F.when(k % 7 == 0, F.lit(" BRAND X ")).when(k % 7 == 1, "brand Y").when(k % 7 == 2, F.concat(F.lit("Nothing "), (k % 3).cast("string"))).when(k % 7 == 3, "Brand z").otherwise(F.concat(F.lit("brand#"), (1 + k % 5).cast("string"), (1 + k % 4).cast("string")))
    links, unmatched = G.bridge_by_strategy(frame(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("uid"), named.alias("strategy")), _of(spark, d, _TARGETS, "part"), aliases)
    return links.select("source_uid", "target_uid", "provenance", "strategy", "section").union(unmatched.select(F.lit(None), F.lit(None), F.lit("unmatched"), "strategy", F.lit(None)))


_ASKED = [("q1", "T1003 steel", None), ("q2", "t1003.001", ""), ("q3", "M1004 T1005", None), ("q4", "BRASS", "Brand#11"), ("q5", "no_such_word", None), ("q6", "f2", None), ("q7", "", "Brand#23")]


def workspace_search(spark, d):
    """Parts as library controls, mapped to two frameworks each, of which some are in scope; their techniques have parts."""
    k = F.col("p_partkey")
    mapping = lambda n: F.struct(F.concat(F.lit("f"), ((k + n) % 6).cast("string")).alias("framework_key"), F.concat(F.lit("u"), (k + n).cast("string")).alias("uid"))
    code = lambda letter, n: F.concat(F.lit(f"{letter}100"), ((k + n) % 9).cast("string"))
    ids = F.array(F.when(k % 2 == 0, F.concat(code("T", 0), F.lit(".001"))).otherwise(code("T", 0)), code("M", 1))
    library = frame(spark, d, "part").select(k.cast("string").alias("id"), F.col("p_brand").alias("topic"), F.array(mapping(0), mapping(1)).alias("mappings"), ids.alias("threat_ids"), F.col("p_type").alias("about"))
    return R.workspace_search(library, spark.createDataFrame(_ASKED, "query_id string, text string, topic string"), spark.createDataFrame([("f0",), ("f1",), ("f2",)], "framework_key string"))


def threat_lookups(spark, d):
    """Techniques of some mitigations, mitigations of some techniques, and citable links of some controls."""
    edges = frame(spark, d, "lineitem").select(F.col("l_partkey").alias("mitigation_id"), F.col("l_suppkey").alias("technique_id"))
    techniques, mitigations = frame(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("technique_id"), "s_name"), frame(spark, d, "part").where("p_size > 9").select(F.col("p_partkey").alias("mitigation_id"), "p_name")
    row = lambda df, what, a, b, c: df.select(F.lit(what).alias("what"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col(c).cast("string").alias("c"))
    out = row(C.techniques_for(mitigations.where("mitigation_id % 4 = 0"), edges, techniques), "technique", "mitigation_id", "technique_id", "s_name")
    out = out.union(row(C.mitigations_for(techniques.where("technique_id % 4 = 1"), edges, mitigations), "mitigation", "technique_id", "mitigation_id", "p_name"))
    links = frame(spark, d, "links")
    return out.union(row(C.links_from(links, links.where("load_seq % 17 = 0").select(F.col("source_uid").alias("uid")), "published"), "link", "source_uid", "target_uid", "load_seq"))


def broad_controls(spark, d):
    """Uids of detailed rows and the broad row that each belongs to."""
    uid = F.concat(F.lit("E8:ML"), (F.col("p_size") % 5).cast("string"), F.lit("-"), F.substring("p_name", 1, 2), F.lit("-"), F.col("p_partkey").cast("string"))
    rows = frame(spark, d, "part").select(uid.alias("uid"))
    return rows.select("uid", C.broad_uid(F.col("uid"), r"e8:ml[123]-([a-z]+)-\d+", {"bl": "S01", "al": "S02", "st": "S03", "pa": "S04"}, "broad").alias("broad_uid"))


QUERIES = {
    f.__name__: f
    for f in (provision_levels, labelled_records, table_row_controls, catalog_controls, topic_report, topic_families, topic_samples, topic_ratings, load_summary, source_audit, lineage, stated_thresholds, threat_graph, markdown_policy_blocks, parameter_references,
        statement_controls, practice_hierarchy, bridge_by_strategy, workspace_search, threat_lookups, broad_controls)
}

_CODES = ", ".join(f"('{c}', '{t}', '{p}')" for c, t, p in _TOPICS)
_TOPIC = f"""{_E}, t(code, topic, pattern) as (values {_CODES}), h as (select code, e.* from e join t on regexp_matches(text, pattern)), pf as (select code, family, count(*) as n from h group by all),
  tot as (select family, count(*) as total from e group by 1), s as (select code, sum(n)::bigint as n, count(*) as families, sum(n / total) as shares from pf join tot using (family) group by 1),
  o as (select code, topic, coalesce(n, 0) as n, coalesce(families, 0) as families, case when coalesce(n, 0) >= 200 then 5 when n >= 100 then 4 when n >= 50 then 3 when n >= 20 then 2 else 1 end::bigint as band,
    round(round(coalesce(shares, 0) / (select count(*) from tot) * 100, 9), 2) as mean_share from t left join s using (code))"""

ORACLES = {
    "provision_levels": rf"""with b as (select * from ({_BLOCKS}) where style <> 'toc'),
      x as (select *, max(case when style = 'part' then idx end) over w as pa, max(case when style = 'division' then idx end) over w as da, max(case when style = 'section' then idx end) over w as ha,
        max(case when style = 'section' and text <> 'Schedule' then idx end) over w as sa, max(case when style = 'subsection' then idx end) over w as oa from b window w as (partition by doc order by idx)),
      y as (select *, case when da > coalesce(pa, -1) then da end as dv, case when sa = greatest(ha, coalesce(pa, -1), coalesce(da, -1)) then sa end as sv from x),
      z as (select y.*, case when oa > sv then oa end as ov, regexp_extract(p.text, '^Part [0-9]+') as pn, nullif(regexp_extract(v.text, '^Division [0-9]+'), '') as dn, regexp_extract(s.text, '^[0-9]+') as sn, regexp_extract(s.text, '^[0-9]+ (.*)$', 1) as st
        from y left join b p on p.doc = y.doc and p.idx = pa left join b v on v.doc = y.doc and v.idx = dv left join b s on s.doc = y.doc and s.idx = sv),
      q as (select z.*, case when regexp_matches(o.text, '^\([0-9]') then ov else sv end as owner from z left join b o on o.doc = z.doc and o.idx = ov),
      tx as (select doc, owner as idx, string_agg(case when style = 'subsection' then regexp_replace(text, '^\([0-9]+\) ', '') else text end, chr(10) order by idx) as t from q where ov is not null and style in ('subsection', 'paragraph', 'penalty') group by all),
      nt as (select doc, owner as idx, count(*) as n from q where ov is not null and style = 'note' group by all),
      c as (select doc, idx, nullif(pn, '') as identifier, regexp_extract(text, '— (.*)$', 1) as title, 0 as depth, null as parent, null as section_ref, true as st0 from z where style = 'part'
        union all select doc, idx, concat_ws(' ', nullif(pn, ''), dn), regexp_extract(text, '— (.*)$', 1), 1, nullif(pn, ''), null, true from z where style = 'division'
        union all select doc, idx, 's ' || sn, st, 2, coalesce(concat_ws(' ', nullif(pn, ''), case when dv is not null then dn end), ''), null, false from z where style = 'section' and sv = idx
        union all select doc, idx, 's ' || sn || regexp_extract(text, '^\([0-9]+\)'), null, 3, 's ' || sn, st, false from z where style = 'subsection' and sv is not null and regexp_matches(text, '^\([0-9]'))
      select doc, idx, identifier, title, depth::bigint as depth, nullif(parent, '') as parent, section_ref, coalesce(t, '') as text, coalesce(n, 0) as n_notes, st0 or (depth = 2 and t is null) as structural from c left join tx using (doc, idx) left join nt using (doc, idx)""",
    "labelled_records": rf"""with l as (select *, regexp_matches(text, '^[0-9]+\.[0-9]+ ') as o, (text = 'Profile:')::int as p, regexp_matches(text, '\(Manual\)$')::int as e from ({_RECORDS})),
      c as (select *, o and greatest(coalesce(lead(p, 1) over w, 0), coalesce(lead(p, 2) over w, 0), coalesce(lead(p, 3) over w, 0), coalesce(lead(p, 4) over w, 0)) = 1 as s from l window w as (partition by doc order by idx)),
      r as (select *, sum(s::int) over (partition by doc order by idx) as record from c),
      b as (select *, last_value(case when s then 'title' when text in ('Profile:', 'Description:') then rtrim(text, ':') end ignore nulls) over (partition by doc, record order by idx) as label, sum(e) over (partition by doc, record order by idx) as z from r where record > 0),
      k as (select * from b where label <> 'title' or z - e = 0), g as (select doc, record, label, string_agg(text, ' ' order by idx) as text from k group by all),
      f as (select doc, record, label, list_sort(list_distinct(regexp_extract_all(text, '\((L[0-9])\)', 1))) as v from g where label in ('title', 'Profile')),
      m as (select doc, record, 'levels' as label, array_to_string(arg_max(v, (label = 'Profile')::int), ',') as text from f where len(v) > 0 group by doc, record)
      select doc, record::bigint as record, label, text from g union all select doc, record::bigint, label, text from m""",
    "table_row_controls": f"""with x as (select *, max(case when k < 3 then idx end) over (partition by page_id order by idx) as ha from ({_PIECES})),
      y as (select x.*, case h.k when 0 then 'L1' when 1 then 'L2' end as level from x join x h on h.page_id = x.page_id and h.idx = x.ha where x.k >= 3 and h.k < 2),
      z as (select *, coalesce(last_value(case when k = 3 then strategy end ignore nulls) over (partition by page_id order by idx), '') as title from y),
      w as (select *, case title when 'Patch' then 'P' when 'Back up' then 'B' when 'Lock' then 'L' end as code from z),
      n as (select *, row_number() over (partition by page_id, level, code order by idx) as nth from w where code is not null)
      select page_id, level || '-' || code || '-' || case when nth < 10 then '0' else '' end || nth as identifier, title, trim(case when k = 3 then name else name || ' ' || idx end) as text, level from n
      union all select distinct page_id, null, null, 'unknown group: ' || title, null from w where code is null
      union all select p.page_id, null, null, 'no rows: ' || v || '-' || c, null from (select distinct page_id from n) p, unnest(['L1', 'L2']) t(v), unnest(['P', 'B', 'L']) u(c) where not exists (select 1 from n where n.page_id = p.page_id and n.level = v and n.code = c)""",
    "catalog_controls": """select c_custkey as doc, 'c-' || c_custkey as id, 'C-' || c_custkey as identifier, 'C-00' || c_custkey as alternates, c_name as title, 'Keep [each [x or ' || c_mktsegment || ']]:' || chr(10) || '  a. for [o]' as text, 'See ' || c_mktsegment as guidance,
        0::bigint as depth, case when c_custkey % 2 = 0 then 'n' || c_nationkey end as parent_id, 'Nation ' || c_nationkey || case when c_custkey % 2 = 1 then ' > ' || c_mktsegment else '' end as section_ref from customer
      union all select c_custkey, 'o-' || o_orderkey, 'O-' || o_orderkey, '', null, o_orderpriority, null, 1, 'c-' || c_custkey, 'Nation ' || c_nationkey || case when c_custkey % 2 = 1 then ' > ' || c_mktsegment else '' end from orders join customer on c_custkey = o_custkey""",
    "topic_report": f"with {_TOPIC} select *, row_number() over (order by n desc, families desc, topic, code) as rank from o",
    "topic_families": f"with {_TOPIC} select * from pf",
    "topic_samples": f"with {_TOPIC} select code, row_number() over (partition by code order by uid) as nth, uid from h qualify nth <= 8",
    "topic_ratings": f"with {_TOPIC} select 'band ' || b as what, count(o.band) as n from range(1, 6) r(b) left join o on o.band = b group by b union all select * from (values ('no pattern: backups', 1), ('unknown topic: a thorn', 1), ('unknown topic: shouting', 1))",
    "load_summary": f"""with f as ({_SUMMED}), ct as (select source as framework_key, count(*) as n from documents where cast(substring(source, 4) as int) % 5 <> 2 group by 1), s as (select f.*, coalesce(n, 0) as n, reason is not null or n is null as gone from f left join ct using (framework_key)),
      st as (select case when o_orderkey % 3 = 0 then 'derived' else 'published' end as p from orders)
      select case when gone then 'not loaded' else 'framework' end as part, framework_key as key, n, case when gone then coalesce(reason, 'no loader ran') else concat_ws(', ', coalesce(revision, 'revision not stated'), fidelity) end as note from s
      union all select 'links', provenance, count(*), null from ({text_of("links")}) group by 2 union all select 'statements', p, count(*), null from st group by 2 union all select 'licence', case when permissive then 'shippable' else 'import only' end, count(*), null from f group by 2
      union all select 'total', 'controls', (select sum(n)::bigint from ct), null union all select 'total', 'links', (select count(*) from lineitem), null union all select 'total', 'statements', (select count(*) from orders), null
      union all select 'total', 'details', (select count(*) from part), null union all select 'total', 'techniques', (select count(*) from supplier), null
      union all select 'loaded', 'frameworks', (select count(*) from s where not gone), null union all select 'loaded', 'families', (select count(distinct coalesce(family, framework_key)) from s where not gone), null
      union all select 'empty tier', t::varchar, 0, null from range(1, 6) r(t) where t not in (select tier from s where n > 0 and tier is not null)""",
    "lineage": f"""with {_REL}, u as (select 'p' || p_partkey % 10 || ':' || p_partkey as uid from part union all select 'x:' || n_nationkey from nation), fr as ({_LINKED}),
      r as (select rel.*, row_number() over (partition by uid, provenance, other_uid order by (not outward)::int desc, load_seq desc) as back from rel where uid in (select uid from u)),
      lst as (select uid, provenance, other_uid, kind as k, outward as o, load_seq as q from r where back = 1),
      o as (select r.uid, r.provenance, r.other_uid, k as kind, o as outward, q as load_seq, row_number() over (partition by r.uid, r.provenance order by coalesce(tier, 99), coalesce(jurisdiction, 99), coalesce(intra_order, 99), split_part(r.other_uid, ':', 1), r.other_uid) as nth
        from r join lst using (uid, provenance, other_uid) left join fr on framework_key = split_part(r.other_uid, ':', 1)),
      b as (select uid, unnest(['published', 'published-tag', 'derived']) as provenance from u), m as (select distinct split_part(uid, ':', 1) as f from rel)
      select b.uid, b.provenance, nth, other_uid, kind, outward, load_seq, case when nth is not null then null when b.provenance = 'derived' then 'nothing was matched to this control'
        when split_part(b.uid, ':', 1) in (select f from m) then split_part(b.uid, ':', 1) || ' has ' || b.provenance || ' links, none of this control' else 'nobody maps ' || split_part(b.uid, ':', 1) end as note from b left join o using (uid, provenance)""",
    "threat_graph": """with e as (select distinct l_partkey as m, l_suppkey as t from lineitem where l_linenumber % 3 <> 0), g as (select * from e where m % 5 <> 0 and t % 4 <> 0 and m in (select p_partkey from part) and t in (select s_suppkey from supplier))
      select 'technique' as part, s_suppkey::bigint as a, 2::bigint as b from supplier where s_suppkey % 4 <> 0 union all select 'mitigation', p_partkey, 2 from part where p_partkey % 5 <> 0
      union all select 'edge', m, t from g union all select 'dropped', m, t from e where not exists (select 1 from g where g.m = e.m and g.t = e.t)""",
    "parameter_references": """with p as (select p_partkey::varchar as command, unnest(string_split(lower(p_type), ' ')) as parameter, lower(p_name || case p_size % 3 when 1 then ' -' || replace(p_type, ' ', ' -') when 2 then ' -' || p_type else '' end) as t from part)
        select command, parameter from p where not contains(t, '-' || parameter)""",
    "markdown_policy_blocks": "select p_partkey % 50 as doc, 'ID-' || p_partkey as identifier, p_name || ' ' || p_type as statement from part",
    "statement_controls": f"""with r as (select framework_key, group_key, trim(section_number) as num, section_title, upper(trim(keyword)) as kw, trim(text) as text, p, load_seq from ({_GROUPED})), gr as (select distinct framework_key, group_key, 'Volume ' || group_key as gt from r),
      t as (select r.*, trim(gt) as gt, case when group_key <> '' then group_key || ' §' || num else num end as sec from r join gr using (framework_key, group_key) where text <> ''),
      n as (select *, row_number() over (partition by framework_key, sec order by load_seq) as nth from t)
      select framework_key, group_key as identifier, trim(gt) as title, 0::bigint as depth, null as parent, null as section_ref, '' as text, 'informative' as obligation, null as keyword, '' as parameters, true as structural from gr where group_key <> ''
      union all select 'none', 'X', null, 0, null, null, '', 'informative', null, '', true
      union all select framework_key, sec, arg_min(section_title, load_seq), 1, nullif(any_value(group_key), ''), any_value(gt), '', 'informative', null, '', true from t where num <> '' group by framework_key, sec
      union all select framework_key, sec || '#' || nth, null, 2, case when num <> '' then sec end, case when num <> '' then group_key || ' §' || num || ' ' || section_title else gt end, text,
        case kw when 'MUST' then 'mandatory' when 'SHOULD NOT' then 'recommended' when 'MAY' then 'permitted' else 'unknown' end, nullif(kw, ''), case when p % 2 = 0 then 'period|p' || p % 3 else '' end, false from n
      union all select framework_key, case kw when '' then 'none' else kw end, 'keyword', count(*), null, null, null, null, null, null, null from t group by 1, 2
      union all select framework_key, q, 'parameter', count(*), null, null, null, null, null, null, null from (select framework_key, unnest(['period', 'p' || p % 3]) as q from t where p % 2 = 0) group by 1, 2
      union all select 'none', 'no statements', 'warning', null, null, null, null, null, null, null, null""",
    "practice_hierarchy": f"""with p as (select *, domain || '-' || objective_number as code from ({_PRACTICED})), f as (select * from p qualify row_number() over (partition by framework_key, identifier order by load_seq) = 1)
      select distinct framework_key, domain as identifier, domain as title, 0::bigint as depth, null as parent, null as section_ref, '' as text, null as level, true as structural from p
      union all select framework_key, code, arg_min(objective, load_seq), 1, any_value(domain), any_value(domain), '', null, true from p group by framework_key, code
      union all select framework_key, identifier, null, 2, code, domain || ' ' || objective, text, case when mil > 0 then 'MIL' || mil end, false from f
      union all select 'm0', 'warning', 'practices: some of 7', null, null, null, null, null, null union all select 'm2', 'warning', 'no practices', null, null, null, null, null, null""",
    "bridge_by_strategy": f"""with m as (select 's' || s_suppkey as uid, case s_suppkey % 7 when 0 then 'BRAND X' when 1 then 'brand Y' when 2 then 'Nothing ' || s_suppkey % 3 when 3 then 'Brand z' else 'brand#' || (1 + s_suppkey % 5) || (1 + s_suppkey % 4) end as strategy from supplier),
      t as (select uid, text, lower(trim(s)) as section from (select uid, text, unnest(string_split(section_ref, '>')) as s from ({_TARGETS}))),
      d as (select m.uid as source_uid, t.uid as target_uid, 'published-tag' as provenance, strategy, section from m join t on section = lower(strategy)), o as (select * from m where lower(strategy) not in (select section from t)),
      a as (select * from (values ('brand x', 'brand#11'), ('brand x', 'brand#22'), ('brand y', 'brand#33'), ('brand z', 'brand#44')) v(name, section)),
      r as (select o.uid as source_uid, t.uid as target_uid, 'derived' as provenance, strategy, section from o join a on name = lower(strategy) join t using (section) where (name <> 'brand x' or contains(lower(text), 'a')) and (name <> 'brand y' or not (contains(lower(text), 'e') or contains(lower(text), 'zz'))))
      select * from d union all select * from r union all select distinct null, null, 'unmatched', strategy, null from o where lower(strategy) not in (select name from a)""",
    "workspace_search": """with l as (select p_partkey as k, p_brand, lower(p_type) as about, p_partkey % 6 as f1, (p_partkey + 1) % 6 as f2, 'T100' || p_partkey % 9 as t, 'M100' || (p_partkey + 1) % 9 as m from part), s as (select * from l where f1 < 3 or f2 < 3)
      select 'q1' as query_id, k::varchar as id from s where t = 'T1003' and contains(about, 'steel') union all select 'q2', k::varchar from s where t = 'T1003' and k % 2 = 0 union all select 'q3', k::varchar from s where t = 'T1005' and m = 'M1004'
      union all select 'q4', k::varchar from s where p_brand = 'Brand#11' and contains(about, 'brass') union all select 'q6', k::varchar from s where 2 in (f1, f2) union all select 'q7', k::varchar from s where p_brand = 'Brand#23'""",
    "threat_lookups": f"""with e as (select distinct l_partkey as m, l_suppkey as t from lineitem), l as ({text_of("links")})
      select 'technique' as what, m::varchar as a, t::varchar as b, s_name as c from e join supplier on s_suppkey = t join part on p_partkey = m where t % 3 > 0 and p_size > 9 and m % 4 = 0
      union all select 'mitigation', t::varchar, m::varchar, p_name from e join part on p_partkey = m join supplier on s_suppkey = t where p_size > 9 and t % 4 = 1 and t % 3 > 0
      union all select 'link', source_uid, target_uid, load_seq::varchar from l where provenance = 'published' and source_uid in (select source_uid from l where load_seq % 17 = 0)""",
    "broad_controls": """with u as (select 'E8:ML' || p_size % 5 || '-' || substr(p_name, 1, 2) || '-' || p_partkey as uid from part)
      select uid, 'broad:' || case when regexp_matches(lower(uid), '^e8:ml[123]-[a-z]+-[0-9]+$') then case split_part(lower(uid), '-', 2) when 'bl' then 'S01' when 'al' then 'S02' when 'st' then 'S03' when 'pa' then 'S04' end end as broad_uid from u""",
}
