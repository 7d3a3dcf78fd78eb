"""Registered queries of reports, audits, sources and sinks, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.fixtures import frame, text_of
from ledgerline.operators import reports as R
from ledgerline.operators import thresholds as T
from ledgerline.operators.corpus import mark_shared_titles
from ledgerline.sources import catalog, sinks, texts

TOPICS = [("licence", "(?i)licens"), ("the", r"\bthe\b"), ("long", r"[a-z]{16,}"), ("digits", "[0-9]{4,}"), ("shouting", r"\b[A-Z]{8,}!!")]


def _entries(spark, d):
    docs = frame(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("uid"), F.col("source").alias("family"), "text", (F.length("text") >= 12).alias("derivable"), F.col("doc_id").alias("load_seq"))


def assessable_entries(spark, d):
    return R.assessable_entries(_entries(spark, d)).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("uid").alias("uids"))


def topic_prevalence(spark, d):
    return R.topic_prevalence(R.assessable_entries(_entries(spark, d)), spark.createDataFrame(TOPICS, "topic string, pattern string"))


def containment_check(spark, d):
    return R.containment_check(frame(spark, d, "benchmark").withColumnRenamed("item_id", "uid"), frame(spark, d, "documents"))


def term_presence(spark, d):
    return R.term_presence(frame(spark, d, "pages"), ["the", "privacy", "copyright", "licens"])


def roundtrip_verify(spark, d):
    return R.roundtrip_verify(frame(spark, d, "benchmark").withColumnRenamed("item_id", "uid"), frame(spark, d, "documents"))


def record_differences(spark, d):
    a = frame(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    b = a.where("o_orderkey % 13 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderpriority")))
    return R.record_differences(a, b, ["o_orderstatus", "o_orderpriority"], "o_orderkey")


def connection_status(spark, d):
    edges = frame(spark, d, "lineitem").select(F.col("l_suppkey").alias("technique_id"), F.col("l_partkey").alias("mitigation_id"))
    asked = frame(spark, d, "part").select((F.col("p_partkey") % 120).alias("technique_id"), F.col("p_partkey").alias("mitigation_id"))
    return R.connection_status(asked, edges.where("technique_id % 5 <> 0"))


def release_gate(spark, d):
    docs = frame(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 5 == 0, ".pdf").otherwise(".json")
    files = docs.select(F.concat(F.when(F.col("doc_id") % 7 == 0, "cache/").otherwise("data/"), F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"), kind).alias("path"), F.col("source").alias("framework_key"))
    licences = frame(spark, d, "frameworks").select("framework_key", F.col("permissive").alias("shippable"))
    return R.release_gate(files, licences)[1]


def mapping_inventory(spark, d):
    sheet = frame(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("a"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("b"))
    return R.mapping_inventory(sheet, ["a", "b"], spark.createDataFrame([("a", 1)], "column string, priority int")).select("column", "mapped", F.col("priority").cast("long").alias("priority"))


def mapping_cells(spark, d):
    cells = frame(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), "; ").alias("cell"))
    targets = frame(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("identifier"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("uid"))
    links, _ = catalog.mapping_cells(cells.withColumn("uid", F.col("l_suppkey")), "cell", "[0-9]+", targets)
    return links


def positional_ids(spark, d):
    rows = frame(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("cell"))
    out = catalog.positional_ids(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "cell")
    return out.select("identifier", "l_partkey", "l_suppkey", "renumbered")


def numbering_gaps(spark, d):
    gaps = catalog.numbering_gaps(frame(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
    return gaps.select("l_orderkey", "l_linenumber")


def forward_fill_sections(spark, d):
    rows = frame(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("section"))
    return catalog.forward_fill(rows, "doc", "idx", ["section"])


def html_list_items(spark, d):
    blocks = texts.html_blocks(frame(spark, d, "pages")).where(F.col("tag").isin("p", "li"))
    return blocks.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("letters"))


def normative_sentences(spark, d):
    req = frame(spark, d, "requirements").select(F.col("subject_id").alias("doc"), "load_seq", "text").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("load_seq", "text"))).alias("s"))
    found = texts.normative_sentences(req.select("doc", F.array_join("s.text", " ").alias("text")))
    return found.select("doc", "sentence", F.array_join("parameters", "|").alias("parameters"))


def assemble_provisions(spark, d):
    blocks = frame(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("idx"), F.col("l_returnflag").alias("style"), F.col("l_linestatus").alias("text"))
    found = texts.assemble_provisions(blocks.distinct(), F.col("style") == "R", F.col("style") == "A")
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("n_blocks").alias("blocks"), F.max(F.length("text")).cast("long").alias("longest"))


def export_rows(spark, d):
    c = mark_shared_titles(frame(spark, d, "controls")).join(frame(spark, d, "frameworks"), "framework_key", "left")
    c = c.select("*", F.col("load_seq").cast("string").alias("identifier"), T.obligation_of(F.col("text")).alias("obligation"), F.lit("published").alias("provenance"), F.lit(0.0).alias("score"), F.col("load_seq").alias("rank"))
    return sinks.export_rows(c).select("uid", "title", F.col("tier").cast("long").alias("tier"), F.col("jurisdiction").cast("long").alias("jurisdiction"), F.md5("text").alias("text_md5"), "rank", "structural")


QUERIES = {
    f.__name__: f
    for f in (
        assessable_entries, topic_prevalence, containment_check, term_presence, roundtrip_verify, record_differences, connection_status, release_gate, mapping_inventory, mapping_cells,
        positional_ids, numbering_gaps, forward_fill_sections, html_list_items, normative_sentences, assemble_provisions, export_rows,
    )
}

_E = "e as (select doc_id as uid, source as family, text from documents where length(text) >= 12 qualify row_number() over (partition by source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) order by doc_id) = 1)"
_SQ = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_TOPICS = ", ".join(f"('{t}', '{p}')" for t, p in TOPICS)

ORACLES = {
    "assessable_entries": f"with {_E} select family, count(*) as n, sum(uid)::bigint as uids from e group by 1",
    "topic_prevalence": f"""with {_E}, t(topic, pattern) as (values {_TOPICS}), h as (select topic, family, count(*) as n from e join t on regexp_matches(text, pattern) group by all), f as (select family, count(*) as total from e group by 1),
        g as (select topic, family, coalesce(n, 0) as n, total from t cross join f left join h using (topic, family)), s as (select topic, sum(n)::bigint as n, count(*) filter (n > 0) as families, round(avg(n / total * 100), 6) as mean_share from g group by 1)
        select *, case when n >= 200 then 5 when n >= 100 then 4 when n >= 50 then 3 when n >= 20 then 2 else 1 end::bigint as band, row_number() over (order by n desc, topic) as rank from s""",
    "containment_check": f"with d as (select {_SQ('text')} as hay from documents) select item_id as uid, (select count(*) from d where contains(hay, needle)) as n from (select item_id, {_SQ('text')} as needle from benchmark)",
    "term_presence": r"""with v as (select page_id, lower(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')) as t from pages),
        m as (select page_id, array_to_string(list_filter(['the', 'privacy', 'copyright', 'licens'], lambda x: not contains(t, x)), '|') as missing from v) select *, case when missing = '' then 'complete' else 'incomplete' end as status from m""",
    "record_differences": """select o_orderkey, unnest(case when o_orderkey % 13 = 0 then ['only left'] when o_orderkey % 7 = 0 and o_orderpriority is not null then ['o_orderpriority'] else [] end) as difference from orders""",
    "connection_status": """with e as (select distinct l_suppkey as t, l_partkey as m from lineitem where l_suppkey % 5 <> 0) select p_partkey % 120 as technique_id, p_partkey as mitigation_id,
        case when exists (select 1 from e where t = p_partkey % 120 and m = p_partkey) then 'published' when p_partkey % 120 in (select t from e) then 'technique only' else 'unknown' end as status from part""",
    "release_gate": f"""with f as (select case when doc_id % 7 = 0 then 'cache/' else 'data/' end || lang || '-' || doc_id || case when doc_id % 5 = 0 then '.pdf' else '.json' end as path, permissive, doc_id from documents join ({text_of("frameworks")}) on framework_key = source)
        select path, case when not permissive then 'licence' when doc_id % 7 = 0 then 'folder' else 'suffix' end as reason from f where not permissive or doc_id % 7 = 0 or doc_id % 5 = 0""",
    "mapping_inventory": """select 'a' as "column", count(*) filter (o_orderkey % 3 = 0) as mapped, 1::bigint as priority from orders union all select 'b', count(*) filter (o_orderstatus <> 'P'), null from orders""",
    "mapping_cells": "select distinct l_suppkey as source_uid, 'part:' || l_partkey as target_uid from lineitem join part on p_partkey = l_partkey where p_partkey % 2 = 0",
    "positional_ids": """with n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as nth from lineitem)
        select l_orderkey || '.' || nth as identifier, l_partkey, l_suppkey, nth <> l_linenumber as renumbered from n""",
    "numbering_gaps": "select * from (select l_orderkey, unnest(generate_series(1, max(l_linenumber)))::bigint as l_linenumber from lineitem group by 1) g where not exists (select 1 from lineitem l where l.l_orderkey = g.l_orderkey and l.l_linenumber = g.l_linenumber)",
    "forward_fill_sections": "select o_custkey as doc, o_orderkey as idx, last_value(case when o_orderkey % 3 = 0 then o_orderpriority end ignore nulls) over (partition by o_custkey order by o_orderkey) as section from orders",
    "html_list_items": r"""with b as (select page_id, unnest(regexp_extract_all(html, '(?is)<p\b[^>]*>.*?</p>|<li\b[^>]*>.*?</li>')) as b from pages)
        select page_id, case when starts_with(lower(b), '<p') then 'p' else 'li' end as tag, count(*) as n, sum(length(trim(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))))::bigint as letters from b group by all""",
    "assemble_provisions": """with b as (select distinct l_suppkey as doc, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey as idx, l_returnflag as style, l_linestatus as text from lineitem where l_returnflag <> 'A'),
        n as (select *, sum(case when style = 'R' then 1 else 0 end) over (partition by doc order by idx) as nth from b), g as (select doc, nth, count(*) as blocks, sum(length(text)) + count(*) - 1 as len from n where nth > 0 group by all)
        select doc, count(*) as n, sum(blocks)::bigint as blocks, max(len)::bigint as longest from g group by 1""",
    "export_rows": f"""select uid, case when trim(title) <> '' and count(*) over (partition by framework_key, lower(trim(title))) > 1 then '' else trim(regexp_replace(title, '\\s+', ' ', 'g')) end as title, tier::bigint as tier, jurisdiction::bigint as jurisdiction,
        md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as text_md5, load_seq as rank, structural from ({text_of("controls")}) left join ({text_of("frameworks")}) using (framework_key)""",
}
