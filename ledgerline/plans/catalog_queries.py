"""Registered queries of small loaders, checks and sinks, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.fixtures import frame, text_of
from ledgerline.operators import corpus as C
from ledgerline.operators import graph as G
from ledgerline.operators import reports as R
from ledgerline.operators import shape as S
from ledgerline.operators import thresholds as T
from ledgerline.operators import vocabulary as V
from ledgerline.plans.graph_queries import _JOINED
from ledgerline.plans.vocabulary_queries import _VOC, _concepts
from ledgerline.sources import catalog, sinks, texts

# Frameworks out of nations, controls out of customers, children of controls out of line items; the same in any engine.
_FRAMEWORKS = """select concat('n', cast(n_nationkey as varchar(20))) as framework_key, case when n_nationkey % 5 = 0 then null else n_nationkey % 5 end as tier, n_nationkey % 3 as levels,
    case when n_nationkey % 2 = 0 then 'r1' end as revision, case when n_nationkey % 4 = 0 then 'named' end as revision_source, n_nationkey % 6 as source_files, 'part' as fidelity from nation"""
_CHILDREN = """select concat('o', cast(l_orderkey as varchar(20))) as control_uid, l_linenumber as nth, l_partkey as part, case when l_returnflag = 'A' then 'published' else 'derived' end as provenance,
    case when l_linenumber % 2 = 0 then 'someone' end as published_by from lineitem"""
_LIBRARY = """select p_partkey as id, p_brand as topic, concat('T', cast(p_size % 7 as varchar(20)), '.', cast(p_size % 3 as varchar(20))) as technique, p_name as name from part"""


def _of(spark, d, sql, table):
    return spark.sql(sql.replace(f"from {table}", "from {t}"), t=frame(spark, d, table))


def link_parents(spark, d):
    rows = frame(spark, d, "hierarchy").select(F.concat(F.lit("h:"), "uid").alias("uid"), F.col("uid").alias("source_id"), F.col("parent_uid").alias("source_parent_id"))
    return catalog.link_parents(rows).select("uid", "parent_uid")


def carried_props(spark, d):
    prop = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).alias("value"))
    rows = frame(spark, d, "orders").select("o_orderkey", F.array(prop("status", "o_orderstatus"), prop("other", "o_orderpriority"), prop("status", "o_orderpriority")).alias("props"))
    return rows.select("o_orderkey", F.array_join(F.element_at(catalog.carry_props(F.col("props"), ["status"]), "status"), "|").alias("status"))


def symmetric_related(spark, d):
    library = frame(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("l_suppkey").alias("related"))
    return catalog.symmetric_related(library)


def parameter_tags(spark, d):
    return frame(spark, d, "requirements").select("text").distinct().select("text", F.array_join(texts.parameter_tags(F.col("text")), "|").alias("tags"))


def resolved_aliases(spark, d):
    uids = frame(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("uid")).distinct()
    aliases = frame(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("old_uid"), F.concat(F.lit("new"), F.col("p_partkey").cast("string")).alias("uid"))
    return C.resolve_aliases(uids, aliases)


def mapped_frameworks(spark, d):
    return G.mapped_frameworks(frame(spark, d, "links"))


def validate_children(spark, d):
    controls = frame(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("uid"))
    good, bad = C.validate_children(_of(spark, d, _CHILDREN, "lineitem"), controls)
    cols = ["control_uid", "nth", "part", "provenance", "published_by"]
    return good.select(*cols, F.lit(True).alias("sound")).union(bad.select(*cols, F.lit(False)))


def known_frameworks(spark, d):
    controls = frame(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("framework_key"), F.when(F.col("c_custkey") % 2 == 0, "full").alias("fidelity"))
    kept, unknown = C.known_frameworks(controls, _of(spark, d, _FRAMEWORKS, "nation").where("levels > 0"))
    cols = ["id", "framework_key", "fidelity"]
    return kept.select(*cols, F.lit(True).alias("known")).union(unknown.select(*cols, F.lit(False)))


def framework_warnings(spark, d):
    return C.framework_warnings(_of(spark, d, _FRAMEWORKS, "nation"))


def evidence_verified(spark, d):
    req = frame(spark, d, "requirements")
    statements = req.groupBy(F.col("subject_id").alias("control")).agg(F.min("text").alias("text"))
    evidence = req.select(F.col("subject_id").alias("control"), F.array(F.lit("review"), F.lit("within")).alias("documents")).distinct()
    return R.evidence_verified(evidence, statements).select("control", "verified")


def workspace_filter(spark, d):
    library = _of(spark, d, _LIBRARY, "part").select("id", "topic", F.array("technique").alias("techniques"), "name")
    return R.workspace_filter(library, "brand#1", None, ["T1", "T2.1"]).select("id")


def _coverage(spark, d):
    controls = frame(spark, d, "controls")
    found = controls.where(F.contains(F.lower("text"), F.lit("licens")))
    return T.coverage(frame(spark, d, "frameworks"), found, found.where("load_seq % 2 = 0"))


def export_status(spark, d):
    absent = _of(spark, d, _FRAMEWORKS, "nation").where("levels = 0").select("framework_key", F.lit("no levels").alias("reason"))
    out = sinks.export_status(_coverage(spark, d), absent)
    return out.select("framework_key", F.col("shown").cast("long").alias("shown"), F.col("total").cast("long").alias("total"), "state")


def result_groups(spark, d):
    return sinks.result_groups(_coverage(spark, d), frame(spark, d, "frameworks")).select("framework_key", "group", "short_name", "state")


def rank_details(spark, d):
    words = lambda t, key: frame(spark, d, t).select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("stem"))
    stems, details = words("documents", F.col("doc_id").alias("uid")), words("benchmark", F.col("item_id").alias("detail_id"))
    weights = stems.groupBy("stem").agg((1 / F.count(F.lit(1))).alias("weight"))
    scope = frame(spark, d, "documents").select(F.col("doc_id").alias("uid"), (F.col("doc_id") % 4).alias("source"))
    concepts = _concepts(spark, d)
    ours = V.concepts_in(frame(spark, d, "documents").select(F.col("doc_id").alias("uid"), "text"), concepts)
    theirs = V.concepts_in(frame(spark, d, "benchmark").select(F.col("item_id").alias("detail_id"), "text"), concepts, "detail_id")
    return S.rank_details(stems, details.withColumn("source", F.col("detail_id") % 4), scope, weights, G.shared_concepts(ours, theirs, right_key="detail_id"), least=0.05)


def coverage_lists(spark, d):
    frameworks = frame(spark, d, "frameworks").withColumn("attribution", F.when(F.col("permissive"), F.concat(F.lit("by "), "short_name")))
    absent = _of(spark, d, _FRAMEWORKS, "nation").where("levels = 0").select("framework_key", F.lit("no levels").alias("reason"))
    return T.coverage_lists(_coverage(spark, d), frameworks, absent)


def release_rules_used(spark, d):
    files = frame(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 7 == 0, "cache/").otherwise("data/"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("framework_key"))
    return R.release_gate(files, frame(spark, d, "frameworks").select("framework_key", F.col("permissive").alias("shippable")))[2]


QUERIES = {
    f.__name__: f
    for f in (link_parents, carried_props, symmetric_related, parameter_tags, resolved_aliases, mapped_frameworks, validate_children, known_frameworks, framework_warnings, evidence_verified, workspace_filter, export_status, result_groups, rank_details, coverage_lists, release_rules_used)
}

_TAGS = ", ".join(f"case when regexp_matches(text, '{p}') then '{n}' end" for n, p in texts.PARAMETERS)
_COV = f"""n as (select framework_key, count(*) as total, count(*) filter (load_seq % 2 = 0) as shown from ({text_of("controls")}) where contains(lower(text), 'licens') group by 1),
  cov as (select framework_key, tier, short_name, coalesce(shown, 0) as shown, coalesce(total, 0) as total, case when total > 0 then 'says' else 'silent' end as state from ({text_of("frameworks")}) left join n using (framework_key) where tier is not null)"""

ORACLES = {
    "link_parents": f"with h as ({text_of('hierarchy')}) select 'h:' || h.uid as uid, 'h:' || p.uid as parent_uid from h left join h p on p.uid = h.parent_uid",
    "carried_props": "select o_orderkey, o_orderstatus || '|' || o_orderpriority as status from orders",
    "symmetric_related": "select l_partkey as id, l_suppkey as related from lineitem where l_partkey <> l_suppkey union select l_suppkey, l_partkey from lineitem where l_partkey <> l_suppkey",
    "parameter_tags": f"select text, concat_ws('|', {_TAGS}) as tags from (select distinct text from ({text_of('requirements')}))",
    "resolved_aliases": "select distinct 'p' || l_partkey as uid, case when l_partkey % 3 = 0 then 'new' else 'p' end || l_partkey as resolved from lineitem",
    "mapped_frameworks": f"with l as ({text_of('links')}) select split_part(source_uid, ':', 1) as framework_key from l union select split_part(target_uid, ':', 1) from l",
    "validate_children": f"select *, substr(control_uid, 2)::bigint % 5 <> 0 and (provenance = 'published') = (published_by is not null) as sound from ({_CHILDREN})",
    "known_frameworks": f"""select c_custkey as id, 'n' || c_nationkey as framework_key, coalesce(case when c_custkey % 2 = 0 then 'full' end, f.fidelity) as fidelity, f.framework_key is not null as known
        from customer left join ({_FRAMEWORKS}) f on f.framework_key = 'n' || c_nationkey and levels > 0""",
    "framework_warnings": f"""with f as ({_FRAMEWORKS}) select framework_key, 'no tier' as warning from f where tier is null union all select framework_key, 'no levels' from f where levels = 0
        union all select framework_key, 'revision without source' from f where revision is not null and revision_source is null union all select framework_key, 'no source' from f where source_files = 0""",
    "evidence_verified": f"select subject_id as control, contains(min(text), 'review') and contains(min(text), 'within') as verified from ({text_of('requirements')}) group by 1",
    "workspace_filter": f"select id from ({_LIBRARY}) where (split_part(technique, '.', 1) in ('T1', 'T2.1') or technique in ('T1', 'T2.1')) and (contains(lower(topic), 'brand#1') or contains(lower(name), 'brand#1'))",
    "export_status": f"with {_COV} select framework_key, shown, total, state from cov union all select framework_key, 0, 0, 'absent: no levels' from ({_FRAMEWORKS}) where levels = 0",
    "result_groups": f"""with {_COV} select framework_key, case when tier <= 3 then '1-3' else tier::varchar end as "group", short_name, state from cov""",
    "coverage_lists": f"""with {_COV} select 'silent' as list, framework_key, null::varchar as note from cov where state = 'silent' union all select 'absent', framework_key, 'no levels' from ({_FRAMEWORKS}) where levels = 0
        union all select 'attribution', framework_key, 'by ' || short_name from cov join ({text_of("frameworks")}) f using (framework_key, short_name) where shown > 0 and permissive""",
    "release_rules_used": f"""with f as (select doc_id, permissive from documents left join ({text_of("frameworks")}) on framework_key = source) select 'licence' as reason, count(*) filter (not coalesce(permissive, false)) as n from f
        union all select 'folder', count(*) filter (permissive and doc_id % 7 = 0) from f union all select unnest(['suffix', 'name']), 0""",
    "rank_details": f"""with {_VOC}, {_JOINED}, t as (select distinct doc_id as uid, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) as stem from documents), w as (select stem, 1.0::double / count(*) as weight from t group by 1),
        own as (select uid, sum(weight) as total from t join w using (stem) group by 1), m as (select distinct item_id as detail_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) as stem from benchmark),
        c as (select uid, detail_id, sum(weight) / any_value(total) as c from t join w using (stem) join m using (stem) join own using (uid) where uid % 4 = detail_id % 4 group by all
          union all select distinct a.doc_id, x.item_id, 0.2::double from dj a join con on contains(a.j, con.n) join bj x on contains(x.j, con.n) where a.doc_id % 4 = x.item_id % 4),
        g as (select uid, detail_id, round(least(1.0, sum(c)), 6) as score from c group by all)
        select * from g where score >= 0.05 qualify row_number() over (partition by uid order by score desc, detail_id) <= 6""",
}
