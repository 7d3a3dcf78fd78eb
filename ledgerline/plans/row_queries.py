"""Registered queries that give the rows of operators whose other queries sum them up, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.fixtures import frame, text_of
from ledgerline.operators import corpus as C
from ledgerline.operators import graph as G
from ledgerline.operators import reports as R
from ledgerline.operators import search as S
from ledgerline.operators import thresholds as T
from ledgerline.plans.analysis_queries import _ST, _stated
from ledgerline.plans.extract_queries import _OBLIGATION
from ledgerline.plans.graph_queries import _NREL, _UPW, _net
from ledgerline.plans.report_queries import _E, _entries
from ledgerline.plans.search_queries import _CTES, _index
from ledgerline.sources import extracts as X
from ledgerline.sources import texts


def link_problems(spark, d):
    links = frame(spark, d, "links").withColumn("tag_side", F.when(F.col("load_seq") % 5 != 0, "source"))
    known = links.select(F.col("source_uid").alias("uid")).union(links.where("load_seq % 11 <> 0").select("target_uid"))
    return C.validate_links(links, known)[1]


def disagreement_rows(spark, d):
    """Each two different statements of a subject, named by their families in order."""
    first = frame(spark, d, "requirements").groupBy("load_seq").agg(F.min("framework_key").alias("framework_key"))
    number = F.substring("framework_key", 3, 9).cast("int")
    first = first.withColumn("family", F.when(number < 8, F.concat(F.lit("family"), F.floor(number / 2).cast("string"))))
    pairs = T.disagreements(_stated(spark, d).join(first, "load_seq"))
    swap = F.col("family") > F.col("r_family")
    side = lambda c, a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(c)
    return pairs.select(
        "subject_id", "dimension", side("one", "family", "r_family"), side("other", "r_family", "family"), side("one_bound", "bound", "r_bound"), side("other_bound", "r_bound", "bound"), side("one_value", "canonical", "r_canonical"),
        side("other_value", "r_canonical", "canonical"), "pairs", "incompatible",
    )


def candidate_rows(spark, d):
    return S.candidates(frame(spark, d, "queries"), _index(spark, d))


def descendant_rows(spark, d):
    return G.descendants(frame(spark, d, "hierarchy")).where("kind <> 'sibling'")


def two_hop_rows(spark, d):
    return G.two_hop_paths(_net(spark, d)).select("start", "via", "end", "first_kind", "second_kind")


def obligations(spark, d):
    return frame(spark, d, "requirements").select("uid", "text", T.obligation_of(F.col("text")).alias("obligation"))


def aligned_titles(spark, d):
    """Documents as functions: the titles that are aligned are the first sixty letters of their texts."""
    half = lambda k: frame(spark, d, "documents").where(f"doc_id % 2 = {k}").select(F.col("doc_id").alias("uid"), F.substring("text", 1, 60).alias("title"), F.lit(0).alias("depth"))
    return G.align_by_title(half(0), half(1))


def html_items(spark, d):
    return texts.html_blocks(frame(spark, d, "pages")).where(F.col("tag").isin("p", "li")).select("page_id", "tag", "text")


def entry_rows(spark, d):
    return R.assessable_entries(_entries(spark, d)).select("uid", "family", "text")


def policy_controls(spark, d):
    items = frame(spark, d, "requirements").select(F.col("subject_id").cast("string").alias("section"), F.when(F.col("load_seq") % 10 == 1, F.col("subject_id").cast("string")).otherwise(F.col("uid")).alias("identifier"), F.lit("Agencies must ensure:").alias("lead_in"), "text", "load_seq")
    return X.policy_items(items.withColumn("load_seq", F.struct("load_seq", "text")), T.obligation_of).withColumn("depth", F.col("depth").cast("long"))


def reference_rows(spark, d):
    lines = frame(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("ref "), F.col("l_partkey").cast("string"), F.lit(" MIL-"), F.col("l_linenumber").cast("string")))), "\n \n").alias("cell"))
    targets = frame(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("identifier"), F.concat(F.lit("t:"), F.col("p_partkey").cast("string")).alias("uid"))
    links, rest = X.practice_references(lines.select(F.col("l_suppkey").cast("string").alias("source_uid"), "cell"), "cell", r"ref (\d+) MIL-(\d)", targets)
    return links.select("source_uid", "target_uid", F.col("maturity").cast("long").alias("n")).union(rest.select(F.lit(None), F.concat(F.lit("unknown "), "identifier"), "n"))


def tactic_rows(spark, d):
    lines = frame(spark, d, "lineitem")
    matches = lines.select(F.col("l_orderkey").alias("uid"), F.col("l_partkey").alias("mitigation_id")).distinct()
    mitigates = lines.select(F.col("l_partkey").alias("mitigation_id"), F.col("l_suppkey").alias("technique_id")).distinct()
    techniques = frame(spark, d, "supplier").select(F.col("s_suppkey").alias("technique_id"), F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("k"), (F.col("s_suppkey") % 3).cast("string"))).alias("tactics"))
    return G.tactic_counts(matches, mitigates, techniques)


QUERIES = {f.__name__: f for f in (link_problems, disagreement_rows, candidate_rows, descendant_rows, two_hop_rows, obligations, aligned_titles, html_items, entry_rows, policy_controls, reference_rows, tactic_rows)}

ORACLES = {
    "link_problems": f"""with l as (select *, case when load_seq % 5 <> 0 then 'source' end as tag_side from ({text_of("links")})), k as (select source_uid as uid from l union select target_uid from l where load_seq % 11 <> 0)
        select load_seq, problem from (select load_seq, case when kind = 'incorporates' and provenance <> 'published' then 'incorporation must be published' when provenance = 'published' and asserted_by is null then 'published needs an asserter'
          when provenance = 'published-tag' and tag_side is null then 'tag needs a side' when provenance = 'derived' and asserted_by is not null then 'derived has no asserter'
          when source_uid not in (select uid from k) then 'unknown source' when target_uid not in (select uid from k) then 'unknown target' end as problem from l) where problem is not null""",
    "disagreement_rows": f"""with {_ST}, u as (select *, case when substr(framework_key, 3)::int < 8 then 'family' || substr(framework_key, 3)::int // 2 else framework_key end as family from st where bound <> 'unstated' and not restates),
        g as (select subject_id, dimension, family, bound, round(canonical, 9) as v, count(*) as n from u group by all)
        select a.subject_id, a.dimension, a.family as one, b.family as other, a.bound as one_bound, b.bound as other_bound, a.v as one_value, b.v as other_value, a.n * b.n as pairs,
          a.bound <> b.bound and case when a.bound = 'at least' then a.v else b.v end > case when a.bound = 'at most' then a.v else b.v end as incompatible
        from g a join g b on a.subject_id = b.subject_id and a.dimension = b.dimension and a.family < b.family and (a.bound <> b.bound or abs(a.v - b.v) >= 1e-9)""",
    "candidate_rows": f"with {_CTES} select distinct query_id, uid from qs join post using (stem)",
    "descendant_rows": f"with recursive {_UPW} select ancestor_uid as uid, uid as relative_uid, case when level = 1 then 'child' else 'descendant' end as kind from up",
    "two_hop_rows": f"""with {_NREL} select x.uid as start, x.other_uid as via, y.other_uid as "end", x.kind as first_kind, y.kind as second_kind from rel x join rel y on x.other_uid = y.uid where y.g <> x.g and y.g <> x.f""",
    "obligations": f"select uid, text, {_OBLIGATION.format(t='text')} as obligation from ({text_of('requirements')})",
    "aligned_titles": "select a.doc_id as source_uid, b.doc_id as target_uid from documents a join documents b on a.doc_id % 2 = 0 and b.doc_id % 2 = 1 and lower(trim(left(a.text, 60))) = lower(trim(left(b.text, 60)))",
    "html_items": r"""with b as (select page_id, unnest(regexp_extract_all(html, '(?is)<p\b[^>]*>.*?</p>|<li\b[^>]*>.*?</li>')) as b from pages)
        select page_id, case when starts_with(lower(b), '<p') then 'p' else 'li' end as tag, trim(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as text from b""",
    "entry_rows": f"with {_E} select uid, family, text from e",
    "policy_controls": f"""with q as ({text_of("requirements")}), i as (select subject_id || '' as section, case when load_seq % 10 = 1 then subject_id || '' else uid end as identifier, text, load_seq, 'Agencies must ensure: ' || text as t from q),
          o as (select section, text, t from i where identifier = section qualify row_number() over (partition by section order by load_seq, text) = 1)
        select s.section as uid, null as parent_uid, 0::bigint as depth, coalesce(text, '') as text, case when t is null then 'informative' else {_OBLIGATION.format(t='t')} end as obligation from (select distinct section from i) s left join o using (section)
          union all select identifier, section, 1, text, {_OBLIGATION.format(t='t')} from i where identifier <> section""",
    "reference_rows": """with r as (select distinct l_suppkey, l_partkey, l_linenumber from lineitem), j as (select r.*, p_partkey from r left join part on p_partkey = l_partkey and p_size > 5)
        select l_suppkey || '' as source_uid, 't:' || l_partkey as target_uid, l_linenumber::bigint as n from j where p_partkey is not null union all select null, 'unknown ' || l_partkey, count(*) from j where p_partkey is null group by l_partkey""",
    "tactic_rows": """with r as (select distinct a.l_orderkey as uid, b.l_suppkey as technique_id from lineitem a join lineitem b on a.l_partkey = b.l_partkey)
        select uid, tactic, count(*)::bigint as n from (select uid, unnest(['n' || s_nationkey, 'k' || s_suppkey % 3]) as tactic from r join supplier on s_suppkey = technique_id) group by all""",
}
