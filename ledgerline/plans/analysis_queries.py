"""Registered queries of thresholds, obligations, coverage and requirement shape, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.fixtures import frame, text_of
from ledgerline.functions import rules
from ledgerline.functions.text import TOKEN, stems_sql
from ledgerline.operators import shape as S
from ledgerline.operators import thresholds as T
from ledgerline.operators import vocabulary as V

# Rule tables of the queries below.
ARCHETYPES = [("record", r"\b[Ll]ogs\b|\brecords\b"), ("periodic", r"\bevery\b"), ("limit", r"\bwithin\b|\bno later than\b|\bmaximum\b"), ("prohibition", r"\bmust not\b"), ("configuration", r"\b[Pp]asswords\b|\bkeys\b")]
PROFILES = [("access goes unreviewed", r"review access", "compare the records of reviews with the list of users"), ("logs are lost", r"[Ll]ogs shall"), ("keys are compromised", r"rotate keys", "read the ages of all keys")]
SOURCES = [("db", "session tokens", 0), ("db", "tokens", 1), ("os", "passwords", 0), ("os", "backups", 1), ("net", "outages", 0)]
LEADS = ["", "Interpretation. ", "A period means this: ", "Who fails this is guilty of an offence. ", "On advice the Minister may decide. "]
# Concepts of quantities, and the subjects that the requirements are held against in turn.
CONCEPTS = [("access", "review access"), ("access", "access records"), ("tokens", "session tokens"), ("keys", "rotate keys"), ("logs", "logs shall be kept")]
SUBJECTS = ["Who may review access?", "Session tokens and rotated keys", "Rotate keys, log shall be kept", "anything at all"]


def _stated(spark, d):
    req = frame(spark, d, "requirements")
    rows = req.groupBy("load_seq", "text").agg(F.min("subject_id").alias("subject_id"))
    # each text is read once, however many requirements repeat it
    return rows.join(T.thresholds(rows.select("text").distinct().withColumn("uid", F.col("text"))).withColumnRenamed("uid", "text"), "text")


def quantities(spark, d):
    texts = frame(spark, d, "requirements").select("text").distinct()
    q = T.quantities(texts.withColumn("uid", F.col("text")))
    return q.select(F.col("uid").alias("text"), F.col("nth").cast("long").alias("nth"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value", "unit")


def threshold_bounds(spark, d):
    texts = frame(spark, d, "requirements").select("text").distinct()
    t = T.thresholds(texts.withColumn("uid", F.col("text")))
    return t.select(F.col("uid").alias("text"), F.col("nth").cast("long").alias("nth"), "dimension", F.round("canonical", 6).alias("canonical"), "bound", "negated", "cadence", "inferred", "restates")


def threshold_compare(spark, d):
    return T.compare(_stated(spark, d)).select("subject_id", "dimension", "n", "unstated", F.round("strictest", 6).alias("strictest"), F.round("loosest", 6).alias("loosest"), "mixed", "approximate")


def disagreements(spark, d):
    req = frame(spark, d, "requirements")
    first = req.groupBy("load_seq").agg(F.min("framework_key").alias("framework_key"))
    # a family for every two frameworks, as their keys follow each other; the last two stand alone
    number = F.substring("framework_key", 3, 9).cast("int")
    first = first.withColumn("family", F.when(number < 8, F.concat(F.lit("family"), F.floor(number / 2).cast("string"))))
    pairs = T.disagreements(_stated(spark, d).join(first, "load_seq"))
    return pairs.groupBy("subject_id", "dimension", F.least("family", "r_family").alias("one"), F.greatest("family", "r_family").alias("other"), "incompatible").agg(F.sum("pairs").alias("n"))


def threshold_clauses(spark, d):
    texts = frame(spark, d, "requirements").select("text").distinct()
    t = T.thresholds(texts.withColumn("uid", F.col("text")))
    return t.select(F.col("uid").alias("text"), F.col("nth").cast("long").alias("nth"), "clause")


def on_subject(spark, d):
    subject = F.element_at(F.array(*[F.lit(t) for t in SUBJECTS]), (F.col("o_orderkey") % len(SUBJECTS) + 1).cast("int"))
    subjects = frame(spark, d, "orders").select(F.col("o_orderkey").alias("subject_id"), subject.alias("text"))
    stated = _stated(spark, d)
    concepts = spark.createDataFrame(CONCEPTS, "concept string, phrase string")
    clauses = V.concepts_in(stated.select("clause", F.col("clause").alias("text")).distinct(), concepts, "clause")
    named = V.concepts_in(subjects.select("text").distinct().withColumn("named", F.col("text")), concepts, "named")
    named = subjects.join(named, F.col("text") == F.col("named")).select("subject_id", "concept")
    return T.on_subject(stated, clauses, named).select("load_seq", F.col("nth").cast("long").alias("nth"), "clause", "on_subject")


def obligation_strength(spark, d):
    req = frame(spark, d, "requirements")
    return req.withColumn("obligation", T.obligation_of(F.col("text"))).groupBy("framework_key", "obligation").agg(F.count(F.lit(1)).alias("n"))


def coverage_bands(spark, d):
    controls, frameworks = frame(spark, d, "controls"), frame(spark, d, "frameworks")
    found = controls.where(F.contains(F.lower("text"), F.lit("licens")))
    out = T.coverage(frameworks, found, found.where("load_seq % 2 = 0"))
    return out.select(F.col("tier").cast("long").alias("tier"), "framework_key", "total", "shown", F.col("hidden").cast("long").alias("hidden"), "state")


def readings(spark, d):
    c = frame(spark, d, "customer").join(frame(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    controls = c.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("uid"), F.concat(F.lit("n"), (F.col("c_nationkey") % 4).cast("string")).alias("framework_key"),
        F.when(F.col("o_orderstatus") == "O", "unknown").otherwise("mandatory").alias("obligation"), (F.col("o_orderkey") % 3 == 0).alias("published"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("priority"), F.col("o_orderpriority")).alias("tags"),
    )
    currency = spark.createDataFrame([("n0", "segment", "market", 0), ("n0", "priority", "level", 1), ("n2", "priority", "level", 0)], "framework_key string, tag string, label string, ord int")
    return T.readings(controls, currency)


def archetypes(spark, d):
    # each text is read once, however many requirements repeat it
    texts = frame(spark, d, "requirements").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    found = S.classify(texts.withColumn("uid", F.col("text")), ARCHETYPES).withColumnRenamed("uid", "text")
    return found.join(texts, "text").select("text", "archetype", "evidence", "n")


def not_derivable(spark, d):
    # a lead-in for every requirement, so that all rows of the rule table come to bear
    lead = F.element_at(F.array(*[F.lit(t) for t in LEADS]), (F.col("load_seq") % len(LEADS) + 1).cast("int"))
    req = frame(spark, d, "requirements").withColumn("title", F.when(F.col("load_seq") % 13 == 0, "Meaning of terms").otherwise("")).withColumn("text", F.when(F.col("load_seq") % 17 == 0, " x ").otherwise(F.concat(lead, "text")))
    reason = S.not_derivable(F.col("title"), F.col("text"), F.col("load_seq") % 19 == 0, F.when(F.col("subject_id") % 9 == 0, F.array(F.lit("Part 2"), F.lit("Definitions"))))
    return req.select("uid", reason.alias("reason"))


def guidance_profile(spark, d):
    texts = frame(spark, d, "requirements").select(F.col("text").alias("uid"), "text").distinct()
    fallback = spark.createDataFrame([("record", "records are missing", "sample the records"), ("limit", "limits are passed", None)], "archetype string, risk string, assessment string")
    return S.guidance(S.classify(texts, ARCHETYPES), texts, PROFILES, fallback).withColumnRenamed("uid", "text")


def detail_scope(spark, d):
    texts = frame(spark, d, "requirements").select(F.col("text").alias("uid"), "text").distinct()
    return S.details_in_scope(texts, spark.createDataFrame(SOURCES, "source string, phrase string, ord int")).withColumnRenamed("uid", "text")


def test_procedures(spark, d):
    texts = frame(spark, d, "requirements").select(F.col("text").alias("uid"), "text").distinct()
    first = S.classify(texts, ARCHETYPES).groupBy("uid").agg(F.min_by("archetype", "ord").alias("archetype"))
    figures = T.quantities(texts).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("nth", F.concat_ws(" ", F.col("value").cast("int").cast("string"), "unit").alias("f")))).alias("s"))
    out = texts.join(first, "uid").join(figures, "uid", "left")
    return out.select("text", S.test_procedure(F.col("archetype"), F.col("text"), F.coalesce("s.f", F.array().cast("array<string>")), F.lit(None).cast("string")).alias("procedure"))


QUERIES = {
    f.__name__: f
    for f in (quantities, threshold_bounds, threshold_compare, threshold_clauses, on_subject, disagreements, obligation_strength, coverage_bands, readings, archetypes, not_derivable, guidance_profile, detail_scope, test_procedures)
}

_R = text_of("requirements")
_Q = rf"(^|[^\w.-])({T.NUMBER})\s*({T.UNITS})\b"
_VALUES = lambda rows: ", ".join("(" + ", ".join(repr(x) if not isinstance(x, bool) else str(x).lower() for x in r) + ")" for r in rows)
_TOKEN = TOKEN.replace("'", "''")
_LIST = lambda xs: ", ".join("'" + x + "'" for x in xs)
_HOURS = "case unit " + " ".join(f"when '{u}' then {v!r}::double" for u, v in {**rules.EXACT_HOURS, **rules.CALENDAR_HOURS}.items()) + " else 1 end"
_WORDS = "case lower(w) " + " ".join(f"when '{u}' then {float(v)}" for u, v in rules.WORD_NUMBERS.items()) + " else try_cast(replace(w, ',', '') as double) end"
_QS = rf"""q0 as (select text, regexp_extract_all(text, '(?i){_Q}') as m, string_split_regex(text, '(?i){_Q}') as g from (select distinct text from ({_R}))),
  q1 as (select text, i - 1 as nth, m[i] as found, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) + length(regexp_extract(m[i], '(?i){_Q}', 1)) as s,
    regexp_extract(m[i], '(?i){_Q}', 2) as w, regexp_replace(lower(regexp_extract(m[i], '(?i){_Q}', 3)), 's$', '') as unit from (select *, unnest(generate_series(1, len(m))) as i from q0)),
  qq as (select text, nth::bigint as nth, s::bigint as start, (s + length(found) - length(regexp_extract(found, '(?i){_Q}', 1)))::bigint as "end", {_WORDS} as value, unit from q1)"""
_BREAKS = rules.CLAUSE_BREAKS
_TH = rf"""{_QS}, bounds(ord, p, bound, own) as (values {_VALUES([(k, *b) for k, b in enumerate(rules.BOUNDS)])}), loose(ord, p, bound) as (values {_VALUES([(k, *b) for k, b in enumerate(rules.LOOSE_BOUNDS)])}),
  t0 as (select *, trim(regexp_replace(lower(substr(text, greatest(start - 52, 0)::int + 1, least(start, 52)::int)), '\s+', ' ', 'g')) as win, case unit when 'bit' then 'bits' when 'character' then 'characters' else 'time' end as dimension, value * {_HOURS} as canonical,
    unit in ('month', 'year') as approximate, substr(text, 1, start::int) as head,
    regexp_replace(regexp_replace(string_split_regex(substr(text, 1, start::int), '{_BREAKS}')[-1] || substr(text, start::int + 1, ("end" - start)::int) || string_split_regex(substr(text, "end"::int + 1), '{_BREAKS}')[1], '\s+', ' ', 'g'), '^[ .;:—-]+|[ .;:—-]+$', '', 'g') as clause from qq where not regexp_matches(substr(text, "end"::int + 1, 12), '{rules.RATE}')),
  rf as (select text, nth, ord, p, bound, own, length(win) - instr(reverse(win), reverse(p)) - length(p) + 1 as pl, length(win) as l from t0, bounds where instr(reverse(win), reverse(p)) > 0),
  b1 as (select text, nth, min_by(bound, (pl, ord)) as bound, min_by(own, (pl, ord)) as own, min(pl) as pl from rf where pl + length(p) >= l - 2 group by all),
  l1 as (select text, nth, max_by(bound, (length(win) - instr(reverse(win), reverse(p)) - length(p), -ord)) as near from t0, loose where instr(reverse(win), reverse(p)) > 0 group by all),
  t1 as (select t0.*, coalesce(bound, 'unstated') as b, coalesce(own, false) as own, case when pl is not null then substr(win, greatest(pl - 24, 0)::int + 1, least(pl, 24)::int) else right(win, 24) end as tail, near,
    {" or ".join(f"suffix(win, '{c}')" for c in rules.CADENCE)} as cadence from t0 left join b1 using (text, nth) left join l1 using (text, nth)),
  t2 as (select *, not own and ({" or ".join(f"contains(tail, '{n}')" for n in rules.NEGATIONS)}) as negated from t1),
  t3 as (select *, case when cadence then 'at most' when negated and b = 'at most' then 'at least' when negated and b = 'at least' then 'at most' else b end as b3 from t2),
  th as (select text, nth, dimension, canonical, approximate, case when b3 = 'unstated' and near is not null then near else b3 end as bound, negated, cadence, b3 = 'unstated' and near is not null as inferred,
    coalesce(lag(dimension) over (partition by text order by nth) = dimension and instr(head, '(') > 0 and instr(reverse(head), '(') < case when instr(reverse(head), ')') = 0 then 1000000 else instr(reverse(head), ')') end and instr(reverse(head), '(') <= 24, false) as restates, clause from t3)"""
_ST = f"{_TH}, rq as (select load_seq, min(subject_id) as subject_id, min(framework_key) as framework_key from ({_R}) group by 1), rt as (select distinct load_seq, text from ({_R})), st as (select * from rt join th using (text) join rq using (load_seq))"
_ARCH = " union all ".join(f"select *, {k} as ord, '{n}' as archetype, lower(regexp_extract(text, '{p}', 0)) as evidence from r where regexp_matches(text, '{p}')" for k, (n, p) in enumerate(ARCHETYPES))
_ARCHN = " or ".join(f"regexp_matches(text, '{p}')" for _, p in ARCHETYPES)

ORACLES = {
    "quantities": f"with {_QS} select * from qq",
    "threshold_bounds": f"with {_TH} select text, nth, dimension, round(canonical, 6) as canonical, bound, negated, cadence, inferred, restates from th",
    "threshold_clauses": f"with {_TH} select text, nth, clause from th",
    "on_subject": rf"""with {_ST}, con(concept, phrase) as (values {_VALUES(CONCEPTS)}), subj as (select o_orderkey as subject_id, (list_value({_LIST(SUBJECTS)}))[o_orderkey % {len(SUBJECTS)} + 1] as s from orders),
        said as (select distinct clause as s from st union select distinct s from subj union select phrase from con), tk as (select s, generate_subscripts(t, 1) as pos, unnest(t) as token from (select s, regexp_extract_all(lower(s), '{_TOKEN}') as t from said)),
        voc as ({stems_sql("(select distinct token from tk)")}), j as (select s, ' ' || string_agg(stem, ' ' order by pos) || ' ' as j from tk join voc using (token) group by 1),
        has as (select distinct j.s, concept from j, con join j n on n.s = con.phrase where contains(j.j, n.j))
        select load_seq, nth, clause, not exists (select 1 from has where has.s = subj.s) or exists (select 1 from has a join has b on a.concept = b.concept where a.s = subj.s and b.s = clause) as on_subject from st join subj using (subject_id)""",
    "threshold_compare": f"""with {_ST}, g as (select subject_id, dimension, count(*) as n, count(*) filter (bound = 'at most') as c, count(*) filter (bound = 'at least') as f, count(*) filter (bound = 'unstated') as unstated, min(canonical) filter (bound = 'at most') as lc,
        max(canonical) filter (bound = 'at most') as hc, min(canonical) filter (bound = 'at least') as lf, max(canonical) filter (bound = 'at least') as hf, bool_or(approximate) as approximate from st where not restates group by all)
        select subject_id, dimension, n, unstated, round(case when c > 0 and f = 0 then lc when f > 0 and c = 0 then hf end, 6) as strictest, round(case when c > 0 and f = 0 then hc when f > 0 and c = 0 then lf end, 6) as loosest, c > 0 and f > 0 as mixed, approximate from g""",
    "disagreements": f"""with {_ST}, u as (select *, case when substr(framework_key, 3)::int < 8 then 'family' || substr(framework_key, 3)::int // 2 else framework_key end as family from st where bound <> 'unstated' and not restates)
        select a.subject_id, a.dimension, least(a.family, b.family) as one, greatest(a.family, b.family) as other, count(*) as n,
        a.bound <> b.bound and case when a.bound = 'at least' then a.canonical else b.canonical end > case when a.bound = 'at most' then a.canonical else b.canonical end as incompatible
        from u a join u b on a.subject_id = b.subject_id and a.dimension = b.dimension and (a.load_seq, a.nth) < (b.load_seq, b.nth) and a.family <> b.family and (a.bound <> b.bound or abs(a.canonical - b.canonical) >= 1e-9) group by all""",
    "obligation_strength": rf"""select framework_key, case when regexp_matches(text, '(?i)\bmust not\b|\bmay not\b') then 'prohibited' when regexp_matches(text, '(?i)\bmust\b|\bis required to\b|\bshall\b') then 'mandatory'
        when regexp_matches(text, '(?i)\bmay\b') then 'permitted' else 'informative' end as obligation, count(*) as n from ({_R}) group by all""",
    "coverage_bands": f"""with f as (select * from ({text_of("controls")}) where contains(lower(text), 'licens')), n as (select framework_key, count(*) as total, count(*) filter (load_seq % 2 = 0) as shown from f group by 1)
        select tier::bigint as tier, framework_key, coalesce(total, 0) as total, coalesce(shown, 0) as shown, coalesce(total - shown, 0) as hidden, case when total > 0 then 'says' else 'silent' end as state from ({text_of("frameworks")}) left join n using (framework_key) where tier is not null""",
    "readings": """select 'o' || o_orderkey as uid, case when o_orderkey % 3 = 0 and o_orderstatus <> 'O' then 'mandatory' when c_nationkey % 4 = 0 then 'market: ' || c_mktsegment || '; level: ' || o_orderpriority
        when c_nationkey % 4 = 2 then 'level: ' || o_orderpriority when o_orderstatus <> 'O' then 'mandatory (read from the wording)' else 'states no strength' end as summary from orders join customer on c_custkey = o_custkey""",
    "archetypes": f"with r as (select load_seq, text from ({_R})) select text, archetype, evidence, count(*) as n from ({_ARCH} union all select *, 99, 'activity', '' from r where not ({_ARCHN})) group by all",
    "not_derivable": rf"""with r as (select uid, subject_id, load_seq, case when load_seq % 13 = 0 then 'Meaning of terms' else '' end as title, case when load_seq % 17 = 0 then 'x' else trim((list_value({_LIST(LEADS)}))[load_seq % {len(LEADS)} + 1] || text) end as text from ({_R}))
        select uid, case when load_seq % 19 = 0 then 'structural' when subject_id % 9 = 0 then 'definition' when length(text) < 12 then 'no text' when title <> '' or regexp_matches(text, '{rules.DEFINITION}') then 'definition'
          when contains(left(text, 240), ' means ') and not regexp_matches(left(text, 240), '{rules.ACTOR}') then 'definition' when contains(text, 'is guilty of an offence') and not regexp_matches(left(text, 200), '{rules.ACTOR}') then 'penalty'
          when contains(left(text, 220), 'the Minister') and not regexp_matches(left(text, 220), '{rules.ACTOR}') then 'power of an office holder' end as reason from r""",
    "guidance_profile": f"""with r as (select distinct text from ({_R})), a as (select text, min_by(archetype, ord) as archetype from ({_ARCH} union all select *, 99, 'activity', '' from r where not ({_ARCHN})) group by 1)
        select text, case {" ".join(f"when regexp_matches(text, '{p[1]}') then '{p[0]}'" for p in PROFILES)} when archetype = 'record' then 'records are missing' when archetype = 'limit' then 'limits are passed' else 'the requirement is not met' end as risk,
        case {" ".join(f"when regexp_matches(text, '{p[1]}') then '{p[2]}'" for p in PROFILES if len(p) > 2)} when archetype = 'record' then 'sample the records' else 'assess whether the requirement is met' end as assessment from a""",
    "detail_scope": f"select text, source, min_by(phrase, ord) as phrase from (select distinct text from ({_R})) join (values {_VALUES(SOURCES)}) s(source, phrase, ord) on contains(lower(text), phrase) group by all",
    "test_procedures": f"""with {_QS}, r as (select distinct text from ({_R})), a as (select text, min_by(archetype, ord) as archetype from ({_ARCH} union all select *, 99, 'activity', '' from r where not ({_ARCHN})) group by 1),
        f as (select text, string_agg(value::int || ' ' || unit, '; ' order by nth) filter (nth < 3) as figs from qq group by 1)
        select text, concat_ws(' ', 'Obtain evidence of the ' || archetype || '.', 'The requirement says: ' || text || '.', 'Check the stated figures: ' || figs || '.') as procedure from a left join f using (text)""",
}
