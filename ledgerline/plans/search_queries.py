"""Registered queries of vocabulary and search, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.fixtures import frame, text_of
from ledgerline.functions import rules
from ledgerline.functions.text import TOKEN, quoted, stems_sql, tokens, with_stem
from ledgerline.operators import assembly as A
from ledgerline.operators import search as S
from ledgerline.operators import vocabulary as V
from ledgerline.operators.common import materialise
from ledgerline.operators.corpus import mark_shared_titles

_TOKEN = TOKEN.replace("'", "''")


def _index(spark, d):
    return S.build_index(frame(spark, d, "controls"))


def token_vocabulary(spark, d):
    words = frame(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return with_stem(words).select("token", "stem", "n")


def stem_df_idf(spark, d):
    return _index(spark, d).stem_stats.select("stem", "df", F.round("idf", 6).alias("idf"))


def postings(spark, d):
    return _index(spark, d).postings.drop("places")


def postings_places(spark, d):
    """Where each stem stands: how many places, the first and the last, and their sum."""
    places = F.col("places").cast("array<bigint>")
    sums = F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x)
    return _index(spark, d).postings.select("uid", "stem", F.size("places").cast("long").alias("n"), F.array_min(places).alias("first"), F.array_max(places).alias("last"), sums.alias("sum"))


def query_terms_weight(spark, d):
    terms = S.query_terms(frame(spark, d, "queries"), _index(spark, d))
    return terms.select("query_id", F.col("term").cast("long").alias("term"), "stem", F.round("weight", 6).alias("weight"))


def candidate_counts(spark, d):
    return S.candidates(frame(spark, d, "queries"), _index(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


def _ranked(spark, d):
    return S.search(frame(spark, d, "queries"), frame(spark, d, "controls"), frame(spark, d, "frameworks"), _index(spark, d))


def search_topk(spark, d):
    return _ranked(spark, d).where("rank <= 25").select("query_id", "uid", "score", "n_matched", "n_terms", F.col("rank").cast("long").alias("rank"))


def search_compose(spark, d):
    shown = S.compose(_ranked(spark, d), frame(spark, d, "frameworks"))
    return shown.select("query_id", "uid", "score", F.col("block").cast("long").alias("block"), F.col("shown").cast("long").alias("shown"))


def _phrases(spark, d):
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    item = frame(spark, d, "benchmark").select(F.col("item_id").alias("concept"), words.alias("w"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    group = F.col("concept") % 5 == 2
    named = item.select("concept", part(1, 3).alias("phrase"), F.lit(0).alias("ord"), F.when(group, "query").alias("side"))
    named = named.union(item.select("concept", part(4, 3), F.lit(1), F.when(group, "control"))).union(item.select("concept", part(7, 2), F.lit(2), F.lit(None)))
    return named, item.where("concept % 4 = 0").select("concept", part(9, 2).alias("phrase"))


def concept_scores(spark, d):
    """Rule tables out of the given texts: a concept for each passage, with its first runs of three, three and two words as phrases.

    Every fifth is a group, named by its first phrase and found by the others; every fourth shuts out texts that say its next two words.
    """
    concepts, excluded = _phrases(spark, d)
    found = V.concept_scores(frame(spark, d, "queries"), frame(spark, d, "controls"), concepts, _index(spark, d), excluded)
    return found.select("query_id", "uid", F.round("conceptual", 6).alias("conceptual"))


def _details(controls):
    """Of broad controls and their details: each control with an even number and the next one."""
    broad, fine = controls.where("load_seq % 2 = 0").select((F.col("load_seq") + 1).alias("load_seq"), F.col("uid").alias("broad_uid")), controls.select("load_seq", "uid")
    return broad.join(fine, "load_seq").select("broad_uid", "uid")


def search_with_concepts(spark, d):
    """Search with concepts; of broad controls and their details the details only."""
    concepts, excluded = _phrases(spark, d)
    queries, controls, index = frame(spark, d, "queries"), frame(spark, d, "controls"), _index(spark, d)
    scores = V.concept_scores(queries, controls, concepts, index, excluded)
    found = S.search(queries, controls, frame(spark, d, "frameworks"), index, concepts=scores, details=_details(controls))
    return found.select("query_id", "uid", "score", "n_matched", "n_terms", F.col("rank").cast("long").alias("rank"))


def search_explained(spark, d):
    """The hits of a search with concepts, an entry of their reasons a row: terms with place and share, concepts with the phrase said, and what else counts."""
    concepts, excluded = _phrases(spark, d)
    queries, controls, frameworks, index = frame(spark, d, "queries"), frame(spark, d, "controls"), frame(spark, d, "frameworks"), _index(spark, d)
    asked = materialise(V.concepts_for(queries.select("query_id", "text"), concepts))
    found = materialise(V.concept_hits(asked, controls, concepts, index, excluded))
    hits = S.search(queries, controls, frameworks, index, concepts=V.best_concepts(asked, found, index), details=_details(controls)).where("rank <= 25")
    hits = materialise(hits.join(controls.select("uid", "structural"), "uid").join(frameworks.select("framework_key", "tier"), "framework_key", "left"))
    why = A.explain(hits, S.evidence(hits, S.query_terms(queries, index), index), V.concept_notes(hits, asked, found))
    rows = why.select("query_id", "uid", F.posexplode("reasons").alias("nth", "r"))
    return rows.select("query_id", "uid", F.col("nth").cast("long").alias("nth"), "r.kind", "r.what", "r.field", F.round("r.share", 6).alias("share"))


def subject_neighbours(spark, d):
    """Every control asked with its own title and text; a control is linked with the next one in load order."""
    controls = mark_shared_titles(frame(spark, d, "controls"))
    after = controls.select(F.col("uid").alias("target_uid"), (F.col("load_seq") - 1).alias("load_seq"))
    links = controls.join(after, "load_seq").select(F.col("uid").alias("source_uid"), "target_uid", F.lit("relates").alias("kind"), F.lit("published").alias("provenance"), F.lit(None).cast("string").alias("asserted_by"), "load_seq")
    return A.subject_neighbours(controls, controls, frame(spark, d, "frameworks"), links, S.build_index(controls))


_STOP = quoted(rules.STOPWORDS)
_CTES = f"""
controls as ({text_of("controls")}), queries as ({text_of("queries")}), frameworks as ({text_of("frameworks")}),
tok as (select uid, 'body' as field, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as token from controls
  union all select uid, 'title', unnest(regexp_extract_all(lower(title), '{_TOKEN}')) from controls
  union all select uid, 'section', unnest(regexp_extract_all(lower(section_ref), '{_TOKEN}')) from controls),
qtok as (select query_id, generate_subscripts(t, 1) - 1 as pos, unnest(t) as token from (select query_id, regexp_extract_all(lower(text), '{_TOKEN}') as t from queries)),
voc as (select token, stem from ({stems_sql("(select token from tok union select token from qtok)")})),
post as (select uid, stem, count(*) filter (field = 'body') as tf_body, count(*) filter (field = 'title') as tf_title, count(*) filter (field = 'section') as tf_section
  from tok join voc using (token) where stem not in ({_STOP}) group by uid, stem),
stats as (select uid, sum(tf_body + tf_title + tf_section)::bigint as length from post group by uid),
totals as (select count(*) as n_docs, avg(length) as average_length from stats),
sdf as (select stem, count(*) as df, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) as idf from post, totals group by stem),
qs as (select query_id, pos, token, stem from qtok join voc using (token) where stem not in ({_STOP})),
qt as (select query_id, min(pos) as term, stem from qs group by query_id, stem),
qw as (select query_id, term, qt.stem, coalesce(idf, ln(1 + (n_docs + 0.5) / 1.5)) as weight from qt left join sdf using (stem), totals),
terms as (select * from qw qualify row_number() over (partition by query_id order by round(weight, 9) desc, term) <= 24),
tw as (select query_id, sum(weight) as total_weight, count(*) as n_terms from terms group by query_id),
hit as (select query_id, uid, n_terms, weight / total_weight as share, tf_body + 2.0::double * tf_title + 0.8::double * tf_section as tf, length, average_length
  from terms join tw using (query_id) join post using (stem) join stats using (uid), totals where tf_body + tf_title > 0),
lit as (select query_id, uid, n_terms, sum(share * tf / (tf + 1.2::double * (0.25::double + 0.75::double * length / average_length))) as literal, sum(share) as coverage, count(*) as n_matched from hit group by query_id, uid, n_terms),
gated as (select * from lit where n_matched >= 2 or round(coverage, 9) >= 0.7),
kept as (select uid, row_number() over (partition by uid order by f, pos) - 1 as place, stem from
  (select uid, 0 as f, generate_subscripts(t, 1) as pos, unnest(t) as token from (select uid, regexp_extract_all(lower(text), '{_TOKEN}') as t from controls)
   union all select uid, 1, generate_subscripts(t, 1), unnest(t) from (select uid, regexp_extract_all(lower(title), '{_TOKEN}') as t from controls)) join voc using (token) where stem not in ({_STOP})),
said as (select uid, ' ' || string_agg(stem, ' ' order by place) || ' ' as joined from kept group by uid),
asked as (select query_id, ' ' || string_agg(stem, ' ' order by pos) || ' ' as needle, count(*) as n from qtok join voc using (token) group by query_id),
scored as (select query_id, uid, framework_key, n_matched, n_terms, round(literal + case when n_matched = n_terms and n_terms > 1 then 0.12 else 0 end
    + case when n > 1 and contains(joined, needle) then 0.2 else 0 end
    + case tier when 1 then 0.06 when 2 then 0.05 when 3 then 0.03 when 4 then 0.02 else 0 end - case when structural then 0.15 else 0 end, 4) as score
  from gated join controls using (uid) left join frameworks using (framework_key) left join said using (uid) left join asked using (query_id)),
floored as (select * from scored qualify score >= greatest(0.12, 0.25 * max(score) over (partition by query_id))),
ranked as (select *, row_number() over (partition by query_id order by score desc, framework_key, uid) as rank from floored)
"""
_CONCEPTS = f"""w as (select item_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as w from benchmark),
ph as (select item_id as concept, 0 as ord, item_id % 5 <> 2 as in_control, true as in_query, array_to_string(w[1:3], ' ') as phrase from w
  union all select item_id, 1, true, item_id % 5 <> 2, array_to_string(w[4:6], ' ') from w union all select item_id, 2, true, true, array_to_string(w[7:8], ' ') from w),
ex as (select item_id as concept, array_to_string(w[9:10], ' ') as phrase from w where item_id % 4 = 0),
pt as (select concept, ord, in_control, in_query, phrase, generate_subscripts(t, 1) as pos, unnest(t) as token from (select *, regexp_extract_all(lower(phrase), '{_TOKEN}') as t from ph)),
pn as (select concept, ord, in_control, in_query, phrase, ' ' || string_agg(stem, ' ' order by pos) || ' ' as p from pt join voc using (token) group by all),
et as (select concept, phrase, generate_subscripts(t, 1) as pos, unnest(t) as token from (select *, regexp_extract_all(lower(phrase), '{_TOKEN}') as t from ex)),
en as (select concept, string_agg(stem, ' ' order by pos) as e from et join voc using (token) group by concept, phrase),
ct as (select uid, generate_subscripts(t, 1) as pos, unnest(t) as token from (select uid, regexp_extract_all(lower(text), '{_TOKEN}') as t from controls)),
full_text as (select uid, string_agg(stem, ' ' order by pos) as j from ct join voc using (token) group by uid),
qc as (select distinct query_id, concept from asked join pn on in_query and contains(needle, p)),
oc as (select uid, concept, phrase, ord, (length(joined) - length(replace(joined, p, ''))) / length(p) as n from said join pn on in_control and contains(joined, p)),
fc as (select uid, concept, min_by(phrase, ord) as phrase, min_by(n, ord) as n from oc group by all),
cs as (select fc.* from fc join full_text using (uid) where not exists (select 1 from en where en.concept = fc.concept and contains(j, e))),
con as (select query_id, uid, max(n / (n + 1.2::double * (0.25::double + 0.75::double * length / average_length))) as conceptual from qc join cs using (concept) join stats using (uid), totals group by all)"""
_FOUND = """g2 as (select query_id, uid, coalesce(literal, 0) as literal, coalesce(n_matched, 0) as n_matched, coalesce(n_terms, 0) as n_terms, coalesce(conceptual, 0) as conceptual
        from lit full join con using (query_id, uid) where coalesce(conceptual, 0) > 0 or n_matched >= 2 or round(coverage, 9) >= 0.7),
      s2 as (select query_id, uid, framework_key, tier, structural, n_matched, n_terms, n > 1 and contains(joined, needle) as phrase, round(greatest(literal, 0.8::double * conceptual) + case when n_matched = n_terms and n_terms > 1 then 0.12 else 0 end
        + case when n > 1 and contains(joined, needle) then 0.2 else 0 end
        + case tier when 1 then 0.06 when 2 then 0.05 when 3 then 0.03 when 4 then 0.02 else 0 end - case when structural then 0.15 else 0 end, 4) as score
        from g2 join controls using (uid) left join frameworks using (framework_key) left join said using (uid) left join asked using (query_id)),
      f2 as (select * from s2 qualify score >= greatest(0.12, 0.25 * max(score) over (partition by query_id))),
      det as (select a.uid as broad_uid, b.uid from controls a join controls b on b.load_seq = a.load_seq + 1 where a.load_seq % 2 = 0),
      k2 as (select * from f2 where not exists (select 1 from det join f2 y on y.uid = det.uid where det.broad_uid = f2.uid and y.query_id = f2.query_id)),
      r2 as (select *, row_number() over (partition by query_id order by score desc, framework_key, uid) as rank from k2)"""
# each control asks for itself: its title (unless shared in its framework) and text
_ASKING = _CTES.replace(
    f"queries as ({text_of('queries')})",
    "queries as (select uid as query_id, concat_ws(' ', case when count(*) over (partition by framework_key, lower(trim(title))) = 1 then title end, text) as text from controls)",
).replace("greatest(0.12, 0.25 *", "greatest(0.35, 0.25 *")

QUERIES = {f.__name__: f for f in (token_vocabulary, stem_df_idf, postings, postings_places, query_terms_weight, candidate_counts, search_topk, search_compose, concept_scores, search_with_concepts, search_explained, subject_neighbours)}

ORACLES = {
    "token_vocabulary": f"with w as (select token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as token from documents) group by token) {stems_sql('w', carried='token, n')}",
    "stem_df_idf": f"with {_CTES} select stem, df, round(idf, 6) as idf from sdf",
    "postings": f"with {_CTES} select * from post",
    "query_terms_weight": f"with {_CTES} select query_id, term, stem, round(weight, 6) as weight from terms",
    "candidate_counts": f"with {_CTES} select query_id, count(distinct uid) as n from qs join post using (stem) group by query_id",
    "search_topk": f"with {_CTES} select query_id, uid, score, n_matched, n_terms, rank from ranked where rank <= 25",
    "concept_scores": f"with {_CTES}, {_CONCEPTS} select query_id, uid, round(conceptual, 6) as conceptual from con",
    "postings_places": f"with {_CTES} select uid, stem, count(place) as n, min(place) as first, max(place) as last, coalesce(sum(place), 0)::bigint as sum from post left join kept using (uid, stem) group by uid, stem",
    "search_with_concepts": f"with {_CTES}, {_CONCEPTS}, {_FOUND} select query_id, uid, score, n_matched, n_terms, rank from r2",
    "search_explained": f"""with {_CTES}, {_CONCEPTS}, {_FOUND}, h as (select * from r2 where rank <= 25),
      m as (select h.query_id, h.uid, 0 as block, terms.term as k, 'term' as kind, q.token as what, case when tf_title > 0 then 'title' else 'text' end as field, weight / total_weight as share
        from h join terms using (query_id) join tw using (query_id) join post on post.uid = h.uid and post.stem = terms.stem join qs q on q.query_id = h.query_id and q.pos = terms.term where tf_body + tf_title > 0),
      e as (select * from m union all select query_id, uid, 1, concept, 'concept', cs.phrase, concept::varchar, null from h join qc using (query_id) join cs using (uid, concept)
        union all select query_id, uid, 2, 0, 'all terms', n_terms::varchar, null, null from h where n_matched = n_terms and n_terms > 1 union all select query_id, uid, 3, 0, 'phrase', null, null, null from h where phrase
        union all select query_id, uid, 4, 0, 'tier', tier::varchar, null, null from h where tier between 1 and 4 union all select query_id, uid, 5, 0, 'heading', null, null, null from h where structural)
      select query_id, uid, row_number() over (partition by query_id, uid order by block, k) - 1 as nth, kind, what, field, round(share, 6) as share from e""",
    "subject_neighbours": f"""with {_ASKING}, lk as (select a.uid, b.uid as neighbour from controls a join controls b on b.load_seq = a.load_seq + 1), l2 as (select * from lk union select neighbour, uid from lk),
      nl as (select uid, count(*) as n from l2 group by uid), k as (select query_id as uid, r.uid as neighbour, score, r.framework_key, rank from ranked r left join nl on nl.uid = query_id where rank <= 32 + coalesce(nl.n, 0)),
      o as (select k.* from k join controls c using (uid) where k.uid <> neighbour and k.framework_key <> c.framework_key and not exists (select 1 from l2 where l2.uid = k.uid and l2.neighbour = k.neighbour))
      select uid, neighbour, score from o qualify row_number() over (partition by uid order by rank) <= 8""",
    "search_compose": f"""with {_CTES}, fam as (select r.*, coalesce(f.family, framework_key) as fam from ranked r left join frameworks f using (framework_key)), best as (select r.*, row_number() over (partition by query_id, fam order by rank) as best,
        exists (select 1 from fam x where x.query_id = r.query_id and x.fam = r.fam and x.rank <= 5) as led from fam r),
      blk as (select *, case when rank <= 5 then 0 when not led and best = 1 then 1 else 2 end as block from best),
      s as (select *, row_number() over (partition by query_id order by block, case when block = 1 then coalesce(tier, 99) end, case when block = 1 then coalesce(jurisdiction, 99) end,
        case when block = 1 then coalesce(intra_order, 99) end, case when block = 1 then framework_key end, rank) as shown from blk left join frameworks using (framework_key))
      select query_id, uid, score, block::bigint as block, shown from s where shown <= 25""",
}
