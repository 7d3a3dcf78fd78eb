"""Registered queries of the publishers' extracts, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.fixtures import frame, text_of
from ledgerline.operators.thresholds import obligation_of
from ledgerline.sources import extracts as X

_PHRASES = [("Supplier#00000000", "ten", 0), ("Supplier#0000000", "hundred", 1), ("Supplier#000000", "thousand", 2)]


def _lines(spark, d):
    return frame(spark, d, "lineitem").withColumn("load_seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def grouped_statements(spark, d):
    words = F.get(F.array(*[F.lit(x) for x in ("MUST", "should", "may", "", "shall not")]), F.col("l_linenumber") % 5)
    rows = _lines(spark, d).select((F.col("l_suppkey") % 10).cast("string").alias("group_key"), F.col("l_orderkey").cast("string").alias("section_number"), words.alias("keyword"),
        F.when(F.col("l_linenumber") % 6 == 0, " ").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("text"), F.array("l_returnflag").alias("parameters"), (F.col("load_seq") * 100 + F.col("l_quantity").cast("int")).alias("load_seq"))
    out = X.grouped_statements(rows, "spec")
    return out.groupBy("parent_uid", "depth", "obligation").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first"), F.max("uid").alias("last"), F.sum("n_parameters").alias("n_parameters")).withColumn("depth", F.col("depth").cast("long"))


def shippable_frameworks(spark, d):
    guides = frame(spark, d, "part").select(F.col("p_brand").alias("framework_key"), F.when(F.col("p_size") > 1, F.upper("p_name")).alias("licence"))
    return X.shippable(guides, " ")


def maturity_practices(spark, d):
    lines = _lines(spark, d)
    rows = lines.select((F.col("l_suppkey") % 7).cast("string").alias("domain"), F.concat((F.col("l_suppkey") % 7).cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("objective"), F.col("l_partkey").cast("string").alias("practice"), F.col("l_linenumber").alias("level"), "load_seq", "l_quantity")
    rows = rows.withColumn("load_seq", F.struct("load_seq", "domain", "objective", "l_quantity"))
    stated = lines.groupBy((F.col("l_suppkey") % 7).cast("string").alias("domain")).agg(F.countDistinct("l_partkey").alias("stated"))
    return X.maturity_practices(rows, stated)[1]


def policy_items(spark, d):
    items = frame(spark, d, "requirements").select(F.col("subject_id").cast("string").alias("section"), F.when(F.col("load_seq") % 10 == 1, F.col("subject_id").cast("string")).otherwise(F.col("uid")).alias("identifier"), F.lit("Agencies must ensure:").alias("lead_in"), "text", "load_seq")
    items = items.withColumn("load_seq", F.struct("load_seq", "text"))
    out = X.policy_items(items, obligation_of)
    return out.groupBy("uid", "depth", "obligation").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text")).withColumn("depth", F.col("depth").cast("long"))


def table_incorporations(spark, d):
    rows = frame(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_uid"), F.col("s_name").alias("cell"), F.lit("as amended").alias("condition"))
    roots = frame(spark, d, "nation").select(F.col("n_name").alias("uid"), F.get(F.array(F.lit("ten"), F.lit("hundred"), F.lit("thousand")), F.col("n_nationkey") % 3).alias("framework_key"), (F.col("n_regionkey") < F.col("n_nationkey") % 3 * 3).alias("structural"))
    return X.incorporations(rows, spark.createDataFrame(_PHRASES, "phrase string, framework_key string, ord int"), roots)[0]


def provision_completeness(spark, d):
    got = frame(spark, d, "orders").select((F.col("o_custkey") * 2).cast("string").alias("identifier"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("text"))
    return X.completeness(got, frame(spark, d, "customer").select((F.col("c_custkey") * 3).cast("string").alias("identifier")))


def practice_references(spark, d):
    lines = _lines(spark, d).groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("ref "), F.col("l_partkey").cast("string"), F.lit(" MIL-"), F.col("l_linenumber").cast("string")))), "\n \n").alias("cell"))
    targets = frame(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("identifier"), F.concat(F.lit("t:"), F.col("p_partkey").cast("string")).alias("uid"))
    links, rest = X.practice_references(lines.select(F.col("l_suppkey").cast("string").alias("source_uid"), "cell"), "cell", r"ref (\d+) MIL-(\d)", targets)
    known = links.groupBy("source_uid").agg(F.count(F.lit(1)).alias("n"), F.sum("maturity").alias("maturity"))
    return known.union(rest.select(F.concat(F.lit("unknown "), "identifier"), "n", F.lit(None).cast("long")))


def moved_class(spark, d):
    controls = frame(spark, d, "part").select(F.concat(F.lit("parts:"), F.col("p_partkey").cast("string")).alias("uid"), F.lit("parts").alias("framework_key"), F.col("p_partkey").cast("string").alias("identifier"), F.col("p_name").alias("text"), "p_type")
    out, aliases, _ = X.move_class(controls, F.startswith("p_type", F.lit("ECONOMY")), "principles")
    return out.join(aliases, "uid", "left").select("uid", "framework_key", "old_uid")


def detail_counts(spark, d):
    rows = _lines(spark, d).select(F.col("l_suppkey").alias("source_key"), F.col("l_partkey").cast("string").alias("identifier"), F.col("l_returnflag").alias("title"), F.col("l_returnflag").alias("description"), F.col("l_linestatus").alias("rationale"), F.struct("load_seq", "l_returnflag", "l_linestatus").alias("load_seq"))
    return X.load_details(rows, frame(spark, d, "supplier").select(F.col("s_suppkey").alias("source_key"), F.lit(70).cast("long").alias("expected")))[1]


def merged_checks(spark, d):
    checks = frame(spark, d, "part").select(F.col("p_partkey").alias("check_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("platform"), F.array("p_type", "p_brand").alias("parents"), F.array(F.col("p_size").cast("string")).alias("references"))
    procedures = frame(spark, d, "part").where("p_size <> 7").select(F.col("p_partkey").alias("check_id"), F.upper("p_name").alias("command"))
    return X.merge_checks(checks, procedures)[1]


def stamped_revisions(spark, d):
    claims = frame(spark, d, "orders").select(F.col("o_custkey").alias("framework_key"), F.col("o_orderstatus").alias("source"), F.concat(F.lit("Edition "), F.col("o_orderkey").cast("string")).alias("cell"),
        F.when(F.col("o_orderkey") % 2 == 0, r"Edition (\d+)").otherwise(r"Version (\d+)").alias("pattern"), F.col("o_orderkey").alias("ord"))
    return X.stamp_revision(frame(spark, d, "customer").select(F.col("c_custkey").alias("framework_key")), claims)


QUERIES = {
    f.__name__: f
    for f in (grouped_statements, shippable_frameworks, maturity_practices, policy_items, table_incorporations, provision_completeness, practice_references, moved_class, detail_counts, merged_checks, stamped_revisions)
}

_OBLIGATION = "case when regexp_matches({t}, '(?i)\\bmust not\\b|\\bmay not\\b') then 'prohibited' when regexp_matches({t}, '(?i)\\bmust\\b|\\bis required to\\b|\\bshall\\b') then 'mandatory' when regexp_matches({t}, '(?i)\\bmay\\b') then 'permitted' else 'informative' end"

ORACLES = {
    "grouped_statements": """with r as (select l_suppkey % 10 || '' as g, l_suppkey % 10 || ' §' || l_orderkey as s, ['mandatory', 'recommended', 'permitted', 'unknown', 'prohibited'][l_linenumber % 5 + 1] as o, l_linenumber, l_quantity, l_orderkey,
          row_number() over (partition by l_suppkey % 10, l_orderkey order by (l_orderkey * 10 + l_linenumber) * 100 + cast(l_quantity as int)) as k from lineitem where l_linenumber % 6 <> 0),
        x as (select 'spec:' || s || '#' || k as uid, 'spec:' || s as p, 2 as depth, o, 1 as np from r union all select distinct 'spec:' || s, 'spec:' || g, 1, 'informative', 0 from r
          union all select distinct 'spec:' || l_suppkey % 10, null, 0, 'informative', 0 from lineitem)
        select p as parent_uid, depth::bigint as depth, o as obligation, count(*) as n, min(uid) as first, max(uid) as last, sum(np)::bigint as n_parameters from x group by all""",
    "shippable_frameworks": "select p_brand as framework_key, bool_and(p_size > 1 and contains(coalesce(p_name, ''), ' ')) as shippable from part group by 1",
    "maturity_practices": """with s as (select l_suppkey % 7 || '' as domain, count(distinct l_partkey) as stated from lineitem group by 1),
        f as (select l_suppkey % 7 || '' as domain from lineitem qualify row_number() over (partition by l_partkey order by l_orderkey * 10 + l_linenumber, l_suppkey % 7 || '', l_suppkey % 7 || '-' || l_suppkey, l_quantity) = 1),
        l as (select domain, count(*) as loaded from f group by 1) select domain, stated, coalesce(loaded, 0) as loaded from s left join l using (domain) where stated <> coalesce(loaded, 0)""",
    "policy_items": f"""with q as ({text_of("requirements")}), i as (select subject_id || '' as section, case when load_seq % 10 = 1 then subject_id || '' else uid end as identifier, text, load_seq, 'Agencies must ensure: ' || text as t from q),
        o as (select section, text, t from i where identifier = section qualify row_number() over (partition by section order by load_seq, text) = 1),
        x as (select s.section as uid, 0 as depth, coalesce(text, '') as text, case when t is null then 'informative' else {_OBLIGATION.format(t='t')} end as obligation from (select distinct section from i) s left join o using (section)
          union all select identifier, 1, text, {_OBLIGATION.format(t='t')} from i where identifier <> section)
        select uid, depth::bigint as depth, obligation, count(*) as n, min(text) as text from x group by all""",
    "table_incorporations": """with n as (select n_name, ['ten', 'hundred', 'thousand'][n_nationkey % 3 + 1] as f, n_regionkey < n_nationkey % 3 * 3 as structural from nation),
        e as (select * from n qualify not structural or bool_and(structural) over (partition by f)),
        s as (select s_suppkey, s_name, case when contains(s_name, 'Supplier#00000000') then 'ten' when contains(s_name, 'Supplier#0000000') then 'hundred' when contains(s_name, 'Supplier#000000') then 'thousand' end as f from supplier)
        select s_suppkey || '' as source_uid, n_name as target_uid, 'incorporates' as kind, 'published' as provenance, s_name || '; as amended' as basis from s join e using (f)""",
    "provision_completeness": """with g as (select o_custkey * 2 || '' as i, count(*) as n, bool_or(o_orderkey % 3 > 0) as f from orders group by 1), e as (select c_custkey * 3 || '' as i, true as e from customer), b as (select * from g full join e using (i))
        select * from (select i as identifier, unnest([case when n is null then 'missing' end, case when e is null then 'unexpected' end, case when n > 1 then 'repeated' end, case when not f then 'empty' end]) as problem from b) where problem is not null""",
    "practice_references": """with r as (select distinct l_suppkey, l_partkey, l_linenumber from lineitem), j as (select r.*, p_partkey from r left join part on p_partkey = l_partkey and p_size > 5)
        select l_suppkey || '' as source_uid, count(*) as n, sum(l_linenumber)::bigint as maturity from j where p_partkey is not null group by 1 union all select 'unknown ' || l_partkey, count(*), null from j where p_partkey is null group by l_partkey""",
    "moved_class": """select case when p_type like 'ECONOMY%' then 'principles:' else 'parts:' end || p_partkey as uid, case when p_type like 'ECONOMY%' then 'principles' else 'parts' end as framework_key, case when p_type like 'ECONOMY%' then 'parts:' || p_partkey end as old_uid from part""",
    "detail_counts": "select s_suppkey as source_key, 70::bigint as expected, count(distinct l_partkey) as loaded from supplier left join lineitem on l_suppkey = s_suppkey group by 1 having count(distinct l_partkey) <> 70",
    "merged_checks": """with c as (select p_partkey, p_name, p_brand, p_size, unnest([p_type, p_brand]) as control_id from part where p_size <> 7)
        select control_id, p_size || '' as uid, p_partkey || ' · ' || p_brand as basis from c qualify row_number() over (partition by control_id, p_size order by lower(p_name) desc, p_partkey desc) = 1""",
    "stamped_revisions": """select c_custkey as framework_key, o_orderkey || '' as revision, o_orderstatus as revision_source from customer left join (select * from orders where o_orderkey % 2 = 0 qualify row_number() over (partition by o_custkey order by o_orderkey) = 1) on o_custkey = c_custkey""",
}
