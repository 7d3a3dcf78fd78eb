"""Registered queries of corpus assembly and identifier lookup, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.fixtures import frame, text_of
from ledgerline.functions import identifiers as I
from ledgerline.operators import corpus as C
from ledgerline.operators import lookup as L

_VERSIONS = """select concat('x', cast(l_partkey as varchar(20))) as uid, case when l_returnflag = 'A' then 'generated' else 'shipped' end as origin,
    l_orderkey * 10 + l_linenumber as load_seq, l_shipdate as published from lineitem"""
_PARENTED = """select concat('c', cast(c_custkey as varchar(20))) as uid, concat('n', cast(c_nationkey as varchar(20))) as framework_key, c_name as identifier,
    case when c_custkey % 10 = 0 then concat('c', cast(c_custkey * 7 as varchar(20))) end as parent_uid, left(c_name, 17) as title from customer"""


def _sql(spark, d, sql):
    return spark.sql(sql.replace("from lineitem", "from {t}").replace("from customer", "from {t}"), t=frame(spark, d, "lineitem" if "lineitem" in sql else "customer"))


def merge_controls(spark, d):
    return C.merge_controls(_sql(spark, d, _VERSIONS))[0].select("uid", "origin", "load_seq")


def merge_warnings(spark, d):
    return C.merge_controls(_sql(spark, d, _VERSIONS))[1]


def shared_titles(spark, d):
    return C.mark_shared_titles(frame(spark, d, "controls")).select("uid", "title_is_shared")


def integrity_report(spark, d):
    frameworks = frame(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("framework_key"), F.when(F.col("n_nationkey") % 6 != 5, 1 + F.col("n_nationkey") % 5).alias("tier"))
    return C.integrity_report(_sql(spark, d, _PARENTED), frameworks, F.regexp_replace(F.lower("identifier"), "0+", "0"))


def governance_order(spark, d):
    placed = C.governance_order(frame(spark, d, "controls"), frame(spark, d, "frameworks"))
    return placed.select("uid", F.col("place").cast("long").alias("place"))


def tier_bands(spark, d):
    return C.tier_bands(frame(spark, d, "frameworks"), frame(spark, d, "controls")).select(F.col("tier").cast("long").alias("tier"), "framework_key", "n")


def load_report(spark, d):
    return C.load_report(frame(spark, d, "frameworks"), frame(spark, d, "controls"), frame(spark, d, "links"))


def validate_links(spark, d):
    links = frame(spark, d, "links").withColumn("tag_side", F.when(F.col("load_seq") % 5 != 0, "source"))
    known = links.select(F.col("source_uid").alias("uid")).union(links.where("load_seq % 11 <> 0").select("target_uid"))
    return C.validate_links(links, known)[1].groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def family_counts(spark, d):
    sources = frame(spark, d, "frameworks")
    families = sources.where("jurisdiction < 3").select("framework_key", F.concat(F.lit("family"), F.col("jurisdiction").cast("string")).alias("family"))
    return C.family_counts(frame(spark, d, "controls"), families)


def preferred_uids(spark, d):
    lines = frame(spark, d, "lineitem")
    uids = lines.select(F.col("l_orderkey").alias("grp"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("uid")).distinct()
    details = frame(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), (F.col("p_partkey") - 1).cast("string")).alias("broad_uid"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("uid"))
    return C.preferred(uids, details, ["grp"])


def statements_for(spark, d):
    got = frame(spark, d, "links").select(F.col("target_uid").alias("control_uid"), "provenance", "load_seq")
    return C.statements_for(got).select("control_uid", "load_seq", F.col("nth").cast("long").alias("nth"))


def _printed(spark, d):
    return frame(spark, d, "printed_ids").withColumn("uid", F.concat_ws(":", "framework_key", "identifier"))


def id_variants(spark, d):
    base = _printed(spark, d).select("uid", I.normalise(F.col("identifier"), True).alias("normalised"))
    return base.select("uid", "normalised", F.array_join(I.variants(F.col("normalised")), "|").alias("forms"))


def id_lookup_status(spark, d):
    found = L.lookup(frame(spark, d, "typed_ids"), L.identifier_index(_printed(spark, d).where("l_linenumber % 6 <> 1"), True), ascii_only=True)
    return found.select("query_id", "normalised", "status", "matched_form", F.array_join("uids", "|").alias("uids"))


def withdrawn_redirects(spark, d):
    printed = _printed(spark, d)
    gone = printed.where("l_linenumber % 6 = 1").select("framework_key", "identifier", F.concat(F.lit("AB-"), F.col("l_orderkey").cast("string"), F.lit("(2)")).alias("target"))
    found = L.lookup(frame(spark, d, "typed_ids"), L.identifier_index(printed.where("l_linenumber % 6 <> 1"), True), redirects=gone, ascii_only=True)
    return found.where("status = 'withdrawn'").select("query_id", "normalised", F.array_join("targets", "|").alias("targets"))


QUERIES = {
    f.__name__: f
    for f in (
        merge_controls, merge_warnings, shared_titles, integrity_report, governance_order, tier_bands, load_report, validate_links, family_counts, preferred_uids, statements_for,
        id_variants, id_lookup_status, withdrawn_redirects,
    )
}

_FW, _CT = text_of("frameworks"), text_of("controls")
_NORM = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(trim({x})), '[]', '()'), '\\s*\\(\\s*', '(', 'g'), '\\s*\\)\\s*', ')', 'g'), '\\(([^()]*)\\)', '.\\1', 'g'), '\\s*-\\s*', '-', 'g'), '(^|[^0-9a-z])0+([0-9])', '\\1\\2', 'g')"

_VAR = """list_filter([n, replace(n, '-', ' '), case when replace(n, ' ', '-') <> n then replace(n, ' ', '-') end, case when replace(n, ' ', '') <> n then replace(n, ' ', '') end,
    case when length(replace(regexp_extract(n, '^[a-z][a-z0-9\\- ]*?[\\- ](\\d[\\d.]*)$', 1), '.', '')) >= 2 then regexp_extract(n, '^[a-z][a-z0-9\\- ]*?[\\- ](\\d[\\d.]*)$', 1) end], lambda x: x is not null)"""
_VARIANTS = f"list_filter({_VAR}, lambda x, i: list_position({_VAR}, x) = i)"
_LOOK = f"""printed as (select *, concat(framework_key, ':', identifier) as uid, {_NORM('identifier')} as n from ({text_of('printed_ids')})),
  live as (select * from printed where l_linenumber % 6 <> 1),
  idx as (select distinct form, kind, uid from (select n as form, 0 as kind, uid from live union all select unnest(list_filter({_VARIANTS}, lambda x: x <> n)), 1, uid from live)),
  q as (select query_id, n, length(t) <= 48 and t <> '' and regexp_matches(t, '[0-9]') and len(string_split_regex(t, '\\s+')) <= 5 as shaped from (select *, {_NORM('query')} as n, trim(query) as t from ({text_of('typed_ids')}))),
  f as (select query_id, n, unnest(v) as form, generate_subscripts(v, 1) as pos from (select *, list_filter({_VARIANTS}, lambda x: not regexp_matches(n, '^[a-z]') or not regexp_matches(x, '^[0-9]')) as v from q where shaped)),
  hit as (select *, min((kind, pos)) over (partition by query_id) as best from f join idx using (form)),
  res as (select query_id, string_agg(distinct uid, '|' order by uid) as uids, count(distinct uid) as k, min(form) as matched_form from hit where (kind, pos) = best group by query_id),
  gone as (select distinct n as form, concat('AB-', l_orderkey, '(2)') as target from printed where l_linenumber % 6 = 1),
  mv as (select query_id, string_agg(distinct target, '|' order by target) as targets from f join gone using (form) group by query_id)"""

ORACLES = {
    "merge_controls": f"select uid, origin, load_seq from ({_VERSIONS}) qualify row_number() over (partition by uid order by case when origin = 'generated' then 0 else 1 end, load_seq) = 1",
    "merge_warnings": f"""select 'duplicate' as stage, uid as key, load_seq from (select *, row_number() over w as n, first(origin) over w as b from ({_VERSIONS})
        window w as (partition by uid order by case when origin = 'generated' then 0 else 1 end, load_seq)) where n > 1 and b = origin""",
    "shared_titles": f"select uid, trim(title) <> '' and count(*) over (partition by framework_key, lower(trim(title))) > 1 as title_is_shared from ({_CT})",
    "integrity_report": f"""with c as ({_PARENTED}), f as (select concat('n', n_nationkey) as framework_key, case when n_nationkey % 6 <> 5 then 1 + n_nationkey % 5 end as tier from nation)
        select 'identifier collision' as kind, framework_key || ':' || k as key, cast(n as varchar) as detail from (select framework_key, regexp_replace(lower(identifier), '0+', '0', 'g') as k, count(*) as n from c group by all) where n > 1
        union all select 'no tier', framework_key, '' from f where tier is null
        union all select 'empty framework', framework_key, '' from f where framework_key not in (select framework_key from c)
        union all select 'orphan parent', uid, parent_uid from c where parent_uid is not null and parent_uid not in (select uid from c)""",
    "governance_order": f"""select uid, row_number() over (order by coalesce(tier, 99), coalesce(jurisdiction, 99), coalesce(intra_order, 99), framework_key, uid) as place from ({_CT}) left join ({_FW}) using (framework_key)""",
    "tier_bands": f"""select t.tier, framework_key, coalesce(n, 0) as n from (select unnest([1, 2, 3, 4, 5])::bigint as tier) t left join (select * from ({_FW}) where tier is not null) f on f.tier = t.tier
        left join (select framework_key, count(*) as n from ({_CT}) group by 1) c using (framework_key)""",
    "load_report": f"""with per as (select framework_key, tier, coalesce(n, 0) as n from ({_FW}) left join (select framework_key, count(*) as n from ({_CT}) group by 1) using (framework_key))
        select 'framework' as part, framework_key as key, n from per union all select 'links', provenance, count(*) from ({text_of("links")}) group by provenance
        union all select 'empty tier', cast(t as varchar), 0 from (select unnest([1, 2, 3, 4, 5]) as t) where t not in (select tier from per where n > 0 and tier is not null)""",
    "validate_links": f"""with l as (select *, case when load_seq % 5 <> 0 then 'source' end as tag_side from ({text_of("links")})), k as (select source_uid as uid from l union select target_uid from l where load_seq % 11 <> 0)
        select problem, count(*) as n from (select case when kind = 'incorporates' and provenance <> 'published' then 'incorporation must be published' when provenance = 'published' and asserted_by is null then 'published needs an asserter'
          when provenance = 'published-tag' and tag_side is null then 'tag needs a side' when provenance = 'derived' and asserted_by is not null then 'derived has no asserter'
          when source_uid not in (select uid from k) then 'unknown source' when target_uid not in (select uid from k) then 'unknown target' end as problem from l) where problem is not null group by problem""",
    "family_counts": f"""select coalesce('family' || jurisdiction, framework_key) as family, count(distinct framework_key) as n_frameworks, count(*) as n from ({_CT}) left join (select framework_key, jurisdiction from ({_FW}) where jurisdiction < 3) using (framework_key) group by 1""",
    "preferred_uids": """with u as (select distinct l_orderkey as grp, l_partkey as p from lineitem) select grp, 'p' || p as uid from u
        where not exists (select 1 from u v join part on p_partkey = v.p where v.grp = u.grp and v.p = u.p + 1 and v.p % 2 = 0)""",
    "statements_for": f"select target_uid as control_uid, load_seq, row_number() over (partition by target_uid order by case when provenance = 'published' then 0 else 1 end, load_seq) as nth from ({text_of('links')})",
    "id_variants": f"select uid, n as normalised, array_to_string({_VARIANTS}, '|') as forms from (select concat(framework_key, ':', identifier) as uid, {_NORM('identifier')} as n from ({text_of('printed_ids')}))",
    "id_lookup_status": f"""with {_LOOK} select query_id, n as normalised, case when not shaped then 'not-an-identifier' when k = 1 then 'unique' when k > 1 then 'ambiguous' else 'none' end as status, matched_form, uids from q left join res using (query_id)""",
    "withdrawn_redirects": f"with {_LOOK} select query_id, n as normalised, targets from q join mv using (query_id) left join res using (query_id) where k is null and shaped",
}
