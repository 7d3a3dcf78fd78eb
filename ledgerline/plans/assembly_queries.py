"""Registered queries of prepared queries, routes, derivations and revalidation, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.fixtures import frame, text_of
from ledgerline.functions import rules
from ledgerline.functions.text import TOKEN, tokens
from ledgerline.operators import assembly as A
from ledgerline.operators import search as S
from ledgerline.operators.common import materialise
from ledgerline.operators.thresholds import quantities
from ledgerline.plans import analysis_queries as N
from ledgerline.plans.report_queries import TOPICS
from ledgerline.plans.search_queries import _CTES, _index, _ranked

_T = TOKEN.replace("'", "''")
_RISKS = [("record", "records are missing"), ("limit", "limits are passed")]
_CURATED = [("^ECONOMY", ["s0:4", "s1:5"], 0), ("^PROMO", ["s2:6"], 1)]


def prepared_queries(spark, d):
    queries = frame(spark, d, "queries")
    t = queries.select("query_id", "text", tokens(F.col("text")).alias("t")).where(F.size("t") >= 3)
    aliases = t.select(F.get("t", 0).alias("token"), F.slice("t", 2, 2).alias("expansion")).distinct()
    return A.prepare_queries(queries, aliases, t.select(F.col("query_id").alias("concept"), F.array_join(F.slice("t", 1, 3), " ").alias("phrase")))


def named_set_listing(spark, d):
    controls = frame(spark, d, "controls")
    listed = A.named_listing(frame(spark, d, "frameworks").select(F.col("short_name").alias("query_id"), "framework_key"), controls)
    return listed.withColumn("rank", F.col("rank").cast("long"))


def search_notes(spark, d):
    queries, index = frame(spark, d, "queries"), _index(spark, d)
    found = S.literal_scores(S.query_terms(queries, index), index).where((F.col("n_matched") >= 2) | (F.round("coverage", 9) >= rules.SOLO))
    kept = S.search(queries, frame(spark, d, "controls"), frame(spark, d, "frameworks"), index)
    # a query without terms stands beside the given ones
    more = queries.select((-F.col("query_id") - 1).alias("query_id"), F.when(F.col("query_id") % 2 == 0, "of the").otherwise("zzzyx qqqzw").alias("text"))
    return A.search_notes(queries.union(more), found, kept, rules.FLOOR)


def analysis_set(spark, d):
    return A.gather(_ranked(spark, d))


def routed_queries(spark, d):
    nations = frame(spark, d, "nation")
    status = F.get(F.array(*[F.lit(x) for x in ("unique", "ambiguous", "withdrawn", "none")]), F.col("n_nationkey") % 4)
    lookups = nations.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query_id"), status.alias("status"), F.when(F.col("n_nationkey") % 4 < 3, F.array("n_name", F.reverse("n_name"))).alias("uids"))
    ids = frame(spark, d, "controls").groupBy("framework_key").agg(F.min("uid").alias("text")).select(F.concat(F.lit("u"), "framework_key").alias("query_id"), "text")
    queries = ids.union(nations.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "n_name")).union(frame(spark, d, "queries").select(F.concat(F.lit("b"), F.col("query_id").cast("string")), "text"))
    ranked = _ranked(spark, d).withColumn("query_id", F.concat(F.lit("b"), F.col("query_id").cast("string")))
    return A.route(queries, frame(spark, d, "controls"), lookups, ranked).withColumn("place", F.col("place").cast("long"))


def analysis_notes(spark, d):
    c = frame(spark, d, "customer")
    way = F.get(F.array(F.lit("keyword"), F.lit("currency"), F.lit("wording")), F.col("c_custkey") % 3)
    readings = c.select(F.col("c_nationkey").alias("subject_id"), F.col("c_mktsegment").alias("short_name"), way.alias("way"))
    bands = frame(spark, d, "nation").select(F.col("n_nationkey").alias("subject_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("tier")).withColumn("n", (F.col("subject_id") + F.col("tier")) % 4)
    stated = c.select(F.col("c_nationkey").alias("subject_id"), F.when((F.col("c_nationkey") % 3 == 0) | (F.col("c_custkey") % 5 > 0), "unstated").otherwise("at most").alias("bound"), (F.col("c_custkey") % 2 == 0).alias("off_subject"))
    return A.analysis_notes(readings, bands, stated)


def related_assessments(spark, d):
    texts = frame(spark, d, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 10).cast("string"), F.lit(":"), F.col("p_partkey").cast("string")).alias("uid"), F.col("p_type").alias("text"))
    curated = A.curated_sources(texts, spark.createDataFrame(_CURATED, "pattern string, uids array<string>, ord int"))
    k = F.col("s_suppkey")
    statements = frame(spark, d, "supplier").select(F.concat(F.lit("s"), (k % 4).cast("string"), F.lit(":"), k.cast("string")).alias("control_uid"), F.when(k % 3 == 0, "derived").otherwise("published").alias("provenance"))
    return A.related_assessments(frame(spark, d, "links"), curated, statements)


def _derived(spark, d, texts=None):
    texts = materialise((frame(spark, d, "requirements") if texts is None else texts).select("text").distinct())  # read again and again below
    controls = texts.select(F.col("text").alias("uid"), F.lit("").alias("title"), "text", F.startswith("text", F.lit("Section")).alias("structural"), F.lit(None).cast("array<string>").alias("ancestor_titles"))
    figures = quantities(controls.select("uid", "text")).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("nth", F.concat_ws(" ", F.col("value").cast("int").cast("string"), "unit").alias("f")))).alias("s")).select("uid", F.col("s.f").alias("figures"))
    return A.derive_all(controls, N.ARCHETYPES, N.PROFILES, spark.createDataFrame(_RISKS, "archetype string, risk string"), figures)


def derived_controls(spark, d):
    return _derived(spark, d).select("uid", "refusal", F.array_join("archetypes", "|").alias("archetypes"), "test", "risk")


def risk_rows(spark, d):
    req = frame(spark, d, "requirements")
    out = A.risk_rows(_derived(spark, d), req.select(F.col("text").alias("uid"), "framework_key").distinct(), req.select(F.col("text").alias("control_uid")))
    return out.select("uid", "risk", "refusal", "n_published", "n_related")


def test_plan_rows(spark, d):
    req = frame(spark, d, "requirements").select("text", "framework_key", (F.col("subject_id") % 5).alias("detail_id"), (F.col("load_seq") % 7 == 0).alias("own")).distinct()
    req = materialise(req)  # one pass over the lines; a text, document, detail and kind stand once
    published = req.where("own").select(F.col("text").alias("uid"), F.concat(F.lit("procedure of "), "framework_key").alias("content"))
    return A.test_plan_rows(_derived(spark, d, req), published, req.select(F.col("text").alias("uid"), F.col("framework_key").alias("source_uid")), req.select(F.col("text").alias("uid"), "detail_id"))


def _candidates(spark):
    return spark.createDataFrame([(n, p, ["src0:0", f"nowhere:{n}"]) for n, p in TOPICS], "candidate string, pattern string, uids array<string>")


def candidate_mentions(spark, d):
    controls = frame(spark, d, "controls")
    details = controls.join(controls.select(F.col("uid").alias("broad_uid"), (F.col("load_seq") + 1).alias("__n")), F.col("load_seq") == F.col("__n")).where("load_seq % 2 = 1").select("broad_uid", "uid")
    families = frame(spark, d, "frameworks").where("permissive").select("framework_key", F.lit("shared").alias("family"))
    return A.candidate_mentions(controls, _candidates(spark), families, details)[0]


def corpus_revalidation(spark, d):
    part = frame(spark, d, "part")
    uid = lambda k: F.concat(F.lit("p"), (k % 10).cast("string"), F.lit(":"), k.cast("string"))
    controls = part.where("p_size > 5").select(uid(F.col("p_partkey")).alias("uid"))
    mappings = part.select(uid(F.col("p_partkey") + F.col("p_size")).alias("uid"))
    parents = frame(spark, d, "orders").select((F.col("o_custkey") + 3).cast("string").alias("control_id"))
    return A.revalidation(controls, frame(spark, d, "links"), mappings, parents, frame(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("control_id")))


def scoped_mappings(spark, d):
    uid = lambda k: F.concat(F.lit("p"), (k % 10).cast("string"), F.lit(":"), k.cast("string"))
    library = frame(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("control_id")).agg(F.collect_set(F.struct(uid(F.col("l_partkey")).alias("uid"), F.col("l_returnflag").alias("relationship"))).alias("mappings"))
    details = frame(spark, d, "part").where("p_partkey % 2 = 1").select(uid(F.col("p_partkey") - 1).alias("broad_uid"), uid(F.col("p_partkey")).alias("uid"))
    scope = frame(spark, d, "region").select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("framework_key"))
    return A.scoped_mappings(library, scope, details)


def preview_catalog(spark, d):
    o = frame(spark, d, "orders")
    controls = o.select(F.col("o_custkey").cast("string").alias("uid"), F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise("id").alias("identifier"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderstatus")).alias("text"))
    return A.preview(controls, 10)


def reports_for_control(spark, d):
    lines = frame(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("control_ids"))
    reports = frame(spark, d, "orders").join(lines, "o_orderkey").select(F.col("o_orderkey").alias("report_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dated"), "control_ids")
    found = A.reports_for(reports, frame(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("control_id")))
    return found.withColumn("nth", F.col("nth").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        prepared_queries, named_set_listing, search_notes, analysis_set, routed_queries, analysis_notes, related_assessments, derived_controls, risk_rows, test_plan_rows, candidate_mentions, corpus_revalidation, scoped_mappings,
        preview_catalog, reports_for_control,
    )
}

_STRICT = f"""{_CTES}, strict as (select query_id, generate_subscripts(t, 1) as pos, t, unnest(t) as token from (select query_id, regexp_extract_all(lower(text), '{_T}') as t from queries) where len(t) >= 3)"""
_ORDERED = f"with r as (select distinct text from ({text_of('requirements')}))"
_MATCH = ", ".join(f"case when regexp_matches(text, '{p}') then '{n}' end" for n, p in N.ARCHETYPES)
_READ = f"""{_ORDERED}, k as (select text, starts_with(text, 'Section') as s, case when concat_ws('|', {_MATCH}) = '' then 'activity' else concat_ws('|', {_MATCH}) end as a from r),
    g as (select text, case when s then 'structural' end as refusal, case when not s then a end as archetypes,
      case when not s then 'There is a risk that ' || case {' '.join(f"when regexp_matches(text, '{p[1]}') then '{p[0]}'" for p in N.PROFILES)}
        else case split_part(a, '|', 1) {' '.join(f"when '{n}' then '{r}'" for n, r in _RISKS)} else 'the requirement is not met' end end || '. The requirement says: ' || text || '.' end as risk from k)"""

ORACLES = {
    "prepared_queries": f"""with {_STRICT}, first as (select query_id, t[1] as token, unnest(t[2:3]) as e, array_to_string(t[1:3], ' ') as phrase, t from (select distinct query_id, t from strict)),
        p as (select query_id as concept, ' ' || string_agg(stem, ' ' order by pos) || ' ' as needle, list(stem) as stems from strict join voc using (token) where pos <= 3 group by 1),
        x as (select query_id, stem, 0 as o from qs union all select qs.query_id, voc.stem, 1 from qs join first using (token) join voc on voc.token = first.e
          union all select query_id, unnest(stems), 2 from asked join p on contains(asked.needle, p.needle))
        select query_id, stem, ['typed', 'alias', 'concept'][min(o) + 1] as origin from x where stem not in ({', '.join("'" + w.replace("'", "''") + "'" for w in rules.STOPWORDS)}) group by 1, 2""",
    "named_set_listing": f"""with c as ({text_of("controls")}), f as ({text_of("frameworks")})
        select short_name as query_id, uid, row_number() over (partition by short_name order by uid) as rank, count(*) over (partition by short_name) as n from c join f using (framework_key) qualify rank <= 25""",
    "search_notes": f"""with {_CTES} select query_id, case when query_id not in (select query_id from qs) then 'the query has no term to search for' when query_id not in (select query_id from gated) then 'nothing loaded is about this'
          when query_id not in (select query_id from floored) then 'the best match is below {rules.FLOOR}' end as note from queries
        union all select -query_id - 1, case when query_id % 2 = 0 then 'the query has no term to search for' else 'nothing loaded is about this' end from queries""",
    "analysis_set": f"with {_CTES} select query_id as subject_id, uid from ranked where rank <= 200",
    "routed_queries": f"""with {_CTES} select 'u' || framework_key as query_id, 'uid' as route, min(uid) as uid, 1::bigint as place, true as shown from controls group by framework_key
        union all select 'n' || n_nationkey, case when n_nationkey % 4 = 2 then 'withdrawn' else 'identifier' end, n_name, 1, true from nation where n_nationkey % 4 < 3
        union all select 'n' || n_nationkey, case when n_nationkey % 4 = 2 then 'withdrawn' else 'identifier' end, reverse(n_name), 2, true from nation where n_nationkey % 4 < 3
        union all select 'b' || query_id, 'subject', uid, rank, rank <= 25 from ranked where rank <= 200""",
    "analysis_notes": """with s as (select c_nationkey as subject_id, string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) filter (c_custkey % 3 = 0) as k, string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) filter (c_custkey % 3 = 1) as c,
          string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) filter (c_custkey % 3 = 2) as w from customer group by 1),
        q as (select c_nationkey as subject_id, c_custkey % 2 = 0 as off, case when c_nationkey % 3 = 0 or c_custkey % 5 > 0 then 0 else 1 end as b from customer), t as (select n_nationkey, unnest([1, 2, 3, 4, 5]) as tier from nation)
        select subject_id, 'strength is not one scale: ' || concat_ws('; ', k || ' by keyword', c || ' by a level of their own', w || ' by the wording only') as note from s where c is not null or w is not null
        union all select n_nationkey, 'nothing at tiers ' || string_agg(tier::varchar, ', ' order by tier) from t where (n_nationkey + tier) % 4 = 0 group by 1
        union all select subject_id, 'numbers stand here, none with a bound' from q where not off group by 1 having sum(b) = 0
        union all select subject_id, count(*) || ' quantities govern something else' from q where off group by 1""",
    "related_assessments": f"""with l as ({text_of("links")}), r as (select source_uid as uid, target_uid as source_uid, provenance, load_seq from l union all select target_uid, source_uid, provenance, load_seq from l),
        k as (select uid, source_uid, arg_max(provenance, (load_seq, provenance)) as connection, 0 as o from r group by all),
        c as (select 'p' || p_partkey % 10 || ':' || p_partkey as uid, unnest(case when p_type like 'ECONOMY%' then ['s0:4', 's1:5'] when p_type like 'PROMO%' then ['s2:6'] end) as source_uid from part),
        b as (select * from k union all select uid, source_uid, 'suggested', 1 from c)
        select uid, source_uid, arg_min(connection, o) as connection from b where uid <> source_uid and source_uid in (select 's' || s_suppkey % 4 || ':' || s_suppkey from supplier where s_suppkey % 3 <> 0) group by 1, 2""",
    "derived_controls": f"{_READ} select text as uid, refusal, archetypes, case when refusal is null then procedure end as test, risk from g left join ({N.ORACLES['test_procedures']}) using (text)",
    "risk_rows": f"""{_READ}, q as (select text, count(*) as n, count(distinct framework_key) as m from ({text_of('requirements')}) group by 1) select text as uid, risk, refusal, n as n_published, m as n_related from g join q using (text)""",
    "test_plan_rows": f"""with q as ({text_of('requirements')}), p as (select distinct text as uid, 'procedure of ' || framework_key as content from q where load_seq % 7 = 0),
        dc as ({_READ} select text as uid, refusal, procedure as test from g left join ({N.ORACLES['test_procedures']}) using (text))
        select uid, 'published' as kind, content from p union all select uid, case when refusal is null then 'derived' else 'refusal' end, coalesce(refusal, test) from dc where uid not in (select uid from p)
        union all select distinct text, 'related', framework_key from q union all select distinct text, 'detail', (subject_id % 5)::varchar from q""",
    "candidate_mentions": f"""with c as ({text_of("controls")}), f as ({text_of("frameworks")}), t as (select unnest([{', '.join(f"{{'n': '{n}', 'p': '{p}'}}" for n, p in TOPICS)}], recursive := true)),
        h as (select t.n as candidate, load_seq, framework_key from c join t on regexp_matches(concat_ws(' ', title, text), p)),
        k as (select * from h where not (load_seq % 2 = 0 and exists (select 1 from h x where x.candidate = h.candidate and x.load_seq = h.load_seq + 1)))
        select candidate, case when permissive then 'shared' else framework_key end as family, count(*) as n from k left join f using (framework_key) group by all""",
    "corpus_revalidation": f"""with c as (select 'p' || p_partkey % 10 || ':' || p_partkey as key from part where p_size > 5), l as ({text_of("links")}), e as (select source_uid as key from l union select target_uid from l),
        m as (select distinct 'p' || (p_partkey + p_size) % 10 || ':' || (p_partkey + p_size) as key from part), p as (select distinct (o_custkey + 3) || '' as key from orders), b as (select distinct c_custkey || '' as key from customer)
        select 'link end' as problem, key from e where key not in (from c) union all select 'mapping', key from m where key not in (from c) union all select 'no check', key from b where key not in (from p) union all select 'no library control', key from p where key not in (from b)""",
    "scoped_mappings": """with m as (select distinct l_suppkey, l_partkey, l_returnflag from lineitem where l_partkey % 10 <= 4)
        select l_suppkey as control_id, 'p' || l_partkey % 10 || ':' || l_partkey as uid, l_returnflag as relationship from m where not (l_partkey % 2 = 0 and l_partkey + 1 in (select p_partkey from part) and exists (select 1 from m x where x.l_suppkey = m.l_suppkey and x.l_partkey = m.l_partkey + 1))""",
    "preview_catalog": """select 'no identifier' as problem, o_custkey || '' as key from orders where o_orderkey % 7 = 0 union all select 'no text', o_custkey || '' from orders where o_orderkey % 11 = 0
        union all select 'repeated', o_custkey || '' from orders group by o_custkey having count(*) > 1 union all select 'number of controls', count(*) || '' from orders having count(*) <> 10""",
    "reports_for_control": """with x as (select distinct l_orderkey as report_id, l_partkey as control_id from lineitem where l_partkey in (select p_partkey from part where p_size < 30))
        select control_id, report_id, strftime(o_orderdate, '%Y-%m-%d') as dated, row_number() over (partition by control_id order by strftime(o_orderdate, '%Y-%m-%d') desc, report_id) as nth from x join orders on o_orderkey = report_id""",
}
