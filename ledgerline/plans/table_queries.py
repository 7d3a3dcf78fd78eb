"""Registered queries of published tables and sheets, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.fixtures import frame
from ledgerline.sources import catalog, tables, texts

# One row for each line of an order; the tables below are derived from it and read the same in any engine.
_LINES = "(select l_orderkey as o, l_linenumber as n, min(l_suppkey) as s, min(l_partkey) as p, min(l_returnflag) as f, l_orderkey * 10 + l_linenumber as load_seq from lineitem group by l_orderkey, l_linenumber)"
_RECORDS = f"""select concat('Guide ', s % 10, ': report of ', f) as report, concat('G', s % 10, ' ', o, '.', n) as identifier, case when o % 4 = 0 then ' ' else concat(o % 9, '') end as section_number,
    concat('Part ', o) as section_title, case when n % 2 = 0 then concat('Heading ', p) end as heading, case when p % 5 = 0 then ' ' else concat('Advice ', p) end as text, load_seq from {_LINES} as x"""
_REQUIREMENTS = f"""select case when n = 7 then ' ' else concat(load_seq, '') end as req_number, case when o % 11 = 0 then '' else concat('D', s % 4) end as domain, case when p % 6 = 5 then null else concat(p % 6, '. Section ', p % 6) end as section,
    case when p % 17 = 0 then null else concat('Entities do ', p) end as release_text, case when n % 5 = 0 then 'Ceased' when n % 5 = 1 then 'No' end as mandatory, case when p % 13 = 0 then 'to be RETIRED' end as decision, load_seq from {_LINES} as x"""
_PRACTICES = f"""select case when o % 10 = 0 then ' ' else concat('D', s % 3) end as domain, concat('O', s % 3, '-', s % 8) as objective_id, concat('Aim ', o) as objective, concat('P', p, '-', n) as practice_id, case when p % 9 = 0 then '' else concat('Do ', o) end as practice,
    concat(n, '') as level, case when n % 2 = 0 then f else ' ' end as profile, load_seq from {_LINES} as x"""
_SHEET = f"""select o as document, load_seq, case when n <> 1 then ' ' when o % 6 = 0 then 'Name' when o % 6 = 3 then concat('Name (F', o % 50, ')') else concat('Name (F', o % 50, '): Outcome ', f) end as function,
    case when n in (2, 4) then concat('Kind (F', o % 50, '.C', p % 20, '): ', case when p % 7 = 0 then concat('[Withdrawn: moved to F', s % 50, '.C', s % 20, ']') else 'Outcome' end) end as category,
    case when n not in (1, 2, 4) then concat('F', o % 50, '.C', p % 20, '-', s, ': ', case when p % 5 = 0 then '[Withdrawn: none]' else concat('Outcome ', p) end) end as subcategory,
    concat('Catalog 1: ', p, ',', chr(10), ' Catalog 2: x', s, chr(10), 'nothing') as refs from {_LINES} as x"""
_MAPPED = f"""select distinct case when o % 19 = 0 then ' ' else concat(p % 20, '.', s) end as number, case when n % 3 = 0 then concat('Title ', s) when n % 3 = 1 then concat(' TITLE  ', s) else 'Other' end as title,
    case when n % 4 = 0 then null else concat('Strategy ', n % 4) end as strategy, case when o % 2 = 0 then 'subset' else 'superset' end as relationship from {_LINES} as x"""
_SAFEGUARDS = f"select distinct concat(p % 20, '.', s, '/', s % 2) as uid, concat(p % 20, '.', s) as identifier, concat('Title ', s) as title from {_LINES} as x where p % 20 <> 7"
_CELLS = f"""select o as t, n - 1 as r, 0 as c, case when n <= 1 + o % 2 then ' ' else f end as v from {_LINES} as x union all select o, n - 1, 1, concat('p', p) from {_LINES} as x
    union all select o, n - 1, 2, case when o % 3 = 0 then ' ' else concat('s', s) end from {_LINES} as x"""

_GROUP, _LEAF, _GONE, _TARGET = r"(?s)^[^(]*\((F\d+(?:\.C\d+)?)\)\s*:?\s*(.*)$", r"(?s)^(F\d+\.C\d+-\d+)\s*:\s*(.*)$", r"^\[Withdrawn", r"(F\d+(?:\.C\d+)?)"


def _of(spark, d, sql):
    return spark.sql(sql.replace("from lineitem", "from {lineitem}"), lineitem=frame(spark, d, "lineitem"))


def _long(df):
    return df.withColumn("depth", F.col("depth").cast("long"))


def guide_controls(spark, d):
    records = _of(spark, d, _RECORDS)
    guides = records.groupBy("report").agg(F.min("load_seq").alias("load_seq")).select("report", "report", "load_seq").toDF("report", "title", "load_seq")
    return _long(tables.guide_controls(guides, records, "guides"))


def requirement_controls(spark, d):
    rows = _of(spark, d, _REQUIREMENTS).withColumnsRenamed({"domain": "Domain", "section": "Section", "release_text": "Release 25 text", "mandatory": "Question Mandatory?", "decision": "Decision in 25"})
    return _long(tables.requirement_controls(rows, "reqs", ["release", "requirement"], ["question mandatory", "decision"], "ceased|retire"))


def practice_controls(spark, d):
    out = tables.practice_controls(_of(spark, d, _PRACTICES), "prac", ["level", "profile"])
    return _long(out).select("uid", "parent_uid", "depth", "title", "text", F.try_element_at("tags", F.lit("level")).alias("level"), F.try_element_at("tags", F.lit("profile")).alias("profile"))


def maturity_controls(spark, d):
    from ledgerline.sources.extracts import maturity_practices

    rows = _of(spark, d, _PRACTICES).select("domain", F.col("objective_id").alias("objective"), F.col("practice_id").alias("practice"), F.col("level").cast("int").alias("level"), "load_seq")
    return _long(maturity_practices(rows, rows.select("domain", F.lit(1).alias("stated")))[0]).withColumn("level", F.col("level").cast("long"))


def _sheet(spark, d):
    return tables.hierarchical_sheet(_of(spark, d, _SHEET), "sheet", _GROUP, _LEAF, _GONE, _TARGET)


def sheet_controls(spark, d):
    return _long(_sheet(spark, d)[0].drop("obligation"))


def sheet_redirects(spark, d):
    return _sheet(spark, d)[1].select("identifier", F.array_join("targets", ",").alias("targets"))


def sheet_references(spark, d):
    cited = _sheet(spark, d)[2].distinct()
    controls = frame(spark, d, "part").where("p_partkey % 3 > 0").select(F.concat(F.lit("cat:"), "p_partkey").alias("uid"), F.lit("cat").alias("framework_key"), F.col("p_partkey").cast("string").alias("identifier"))
    links, external = tables.reference_links(cited, spark.createDataFrame([("Catalog 1", "cat")], "source string, framework_key string"), controls)
    return links.union(external.select("uid", "identifier", "source"))


def _mapping(spark, d):
    return tables.mapping_tags(_of(spark, d, _MAPPED), _of(spark, d, _SAFEGUARDS))


def mapping_tags(spark, d):
    return _mapping(spark, d)[0]


def mapping_unresolved(spark, d):
    return _mapping(spark, d)[1].withColumn("candidates", F.col("candidates").cast("long"))


def real_titles(spark, d):
    rows = frame(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Control: AB-"), "p_partkey")).when(F.col("p_partkey") % 3 == 1, " - ").otherwise(F.concat(F.lit(" "), "p_name")).alias("title"), F.concat(F.lit("ab"), "p_partkey").alias("id"))
    return rows.select("p_partkey", catalog.real_title(F.col("title"), F.col("id"), F.lit("AB")).alias("title"))


def published_procedures(spark, d):
    parts = _of(spark, d, f"select * from {_LINES} as x").select(F.col("o").alias("control_uid"), F.get(F.array(F.lit("assessment-objective"), F.lit("assessment-method"), F.lit("item")), F.col("n") % 3).alias("name"),
        F.when(F.col("f") == "A", "EXAMINE").otherwise("test").alias("method"), F.when(F.col("p") % 4 > 0, F.concat(F.lit("records of "), "p")).alias("prose"), F.col("n").alias("ord"))
    return catalog.published_procedures(parts).select("control_uid", "kind", "text", "provenance", F.col("ord").cast("long").alias("ord"))


def staged_texts(spark, d):
    rows = frame(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("Initial"), F.when(F.col("o_orderkey") % 2 > 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise(" ").alias("Managed"))
    return catalog.wide_stages(rows, ["Initial", "Managed"]).select("uid", "text", F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("stages"))


def statement_texts(spark, d):
    parts = _of(spark, d, f"select * from {_LINES} as x").select(F.col("o").alias("control_uid"), F.when(F.col("n") % 2 == 0, F.array("n")).otherwise(F.array(F.col("n") - 1, F.col("n"))).alias("path"), F.when(F.col("n") % 3 > 0, F.concat("n", F.lit("."))).alias("label"), F.concat(F.lit("do "), "p").alias("prose"))
    return catalog.part_text(parts)


def folded_tables(spark, d):
    return texts.fold_tables(_of(spark, d, _CELLS).toDF("table", "row", "col", "val")).select(F.col("table").alias("t"), F.col("row").cast("long").alias("r"), "text")


def lettered_items(spark, d):
    lines = _of(spark, d, f"select o as section, n as idx, case when n % 2 = 0 then concat('(a) do ', p) else concat('line ', p) end as text from {_LINES} as x")
    return texts.lettered_items(lines)


def mended_texts(spark, d):
    rows = _of(spark, d, f"select load_seq, concat('multi-', chr(10), ' factor within ', p, ' days', n, '  and pass-', chr(10), 'and') as text from {_LINES} as x")
    return rows.select("load_seq", texts.mend(F.col("text")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (guide_controls, requirement_controls, practice_controls, maturity_controls, sheet_controls, sheet_redirects, sheet_references, mapping_tags, mapping_unresolved, real_titles, published_procedures, staged_texts, statement_texts,
        folded_tables, lettered_items, mended_texts)
}

_SHEET_READ = rf"""with q as ({_SHEET}), r as (select document, load_seq, refs, case when trim(function) <> '' then 0 when category is not null then 1 when subcategory is not null then 2 end as depth,
        trim(case when trim(function) <> '' then function else coalesce(category, subcategory) end) as cell from q),
    i as (select *, case when depth = 2 then regexp_extract(cell, '^(F\d+\.C\d+-\d+)', 1) else nullif(regexp_extract(cell, '\((F\d+(\.C\d+)?)\)', 1), '') end as id, trim(case when contains(cell, ': ') then substr(cell, instr(cell, ': ') + 2) else '' end) as text from r where depth is not null),
    k as (select * from i where id is not null and (depth > 0 or text <> '')),
    w as (select *, last_value(case when depth = 0 then id end ignore nulls) over d as f, last_value(case when depth = 1 then id end ignore nulls) over d as c, depth > 0 and starts_with(text, '[Withdrawn') as gone
      from k window d as (partition by document order by load_seq rows between unbounded preceding and current row))"""
_STORED = r"regexp_replace(regexp_replace({}, '(\.\d*?)0+$', '\1'), '\.$', '')"
_PLAIN = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_MAPPING = f"""with r as ({_MAPPED}), m as (select distinct {_STORED.format('number')} as number, title, {_PLAIN.format('title')} as t, strategy, relationship from r where trim(number) <> '' and strategy is not null),
    c as (select uid, {_STORED.format('identifier')} as number, {_PLAIN.format('title')} as t from ({_SAFEGUARDS}) as g),
    x as (select m.*, (select count(*) from c where c.number = m.number) as n, (select count(*) from c where c.number = m.number and c.t = m.t) as k, (select min(uid) from c where c.number = m.number) as u,
      (select min(uid) from c where c.number = m.number and c.t = m.t) as v from m)"""

ORACLES = {
    "guide_controls": f"""with r as ({_RECORDS}), g as (select report, min(load_seq) as q from r group by 1)
        select 'guides:' || lower(split_part(report, ':', 1)) as uid, null as parent_uid, 0::bigint as depth, report as title, '' as text, 'informative' as obligation from g qualify row_number() over (partition by uid order by q) = 1
        union all (select 'guides:' || lower(split_part(identifier, ' ', 1)) || ' ' || section_number as uid, 'guides:' || lower(split_part(report, ':', 1)), 1, section_title, '', 'informative' from r where section_number <> ' ' qualify row_number() over (partition by uid order by load_seq) = 1)
        union all (select 'guides:' || lower(identifier), case when section_number <> ' ' then 'guides:' || lower(split_part(identifier, ' ', 1)) || ' ' || section_number end, 2, heading, text, 'recommended' from r where text <> ' ')""",
    "requirement_controls": f"""with r as (select req_number as n, nullif(domain, '') as d, section as s, release_text as t, regexp_matches(lower(coalesce(mandatory, '') || ' ' || coalesce(decision, '')), 'ceased|retire') as ceased, load_seq from ({_REQUIREMENTS}) as y where req_number <> ' ' and release_text is not null),
        u as (select *, 'reqs:' || lower(d) as du, 'reqs:' || lower(trim(coalesce(d, '') || ' ' || split_part(s, '.', 1))) as su from r)
        select du as uid, null as parent_uid, 0::bigint as depth, d as title, '' as text, 'informative' as obligation, false as ceased from u where du is not null qualify row_number() over (partition by du order by load_seq) = 1
        union all (select su, du, 1, s, '', 'informative', false from u where su is not null qualify row_number() over (partition by su order by load_seq) = 1)
        union all (select 'reqs:req ' || n, coalesce(su, du), 2, null, t, case when ceased then 'informative' else 'mandatory' end, ceased from u)""",
    "practice_controls": f"""with u as (select *, 'prac:' || lower(nullif(domain, ' ')) as du, 'prac:' || lower(objective_id) as ou from ({_PRACTICES}) as y where practice <> '')
        select du as uid, null as parent_uid, 0::bigint as depth, domain as title, '' as text, null as level, null as profile from u where du is not null qualify row_number() over (partition by du order by load_seq) = 1
        union all (select ou, du, 1, null, objective, null, null from u qualify row_number() over (partition by ou order by load_seq) = 1)
        union all (select 'prac:' || lower(practice_id), ou, 2, null, practice, level, nullif(profile, ' ') from u qualify row_number() over (partition by practice_id order by load_seq) = 1)""",
    "maturity_controls": f"""with f as (select * from ({_PRACTICES}) as y qualify row_number() over (partition by practice_id order by load_seq) = 1)
        select distinct domain as uid, null as parent_uid, 0::bigint as depth, null::bigint as level from f union all (select distinct objective_id, domain, 1, null from f) union all select practice_id, objective_id, 2, level::bigint from f""",
    "sheet_controls": f"""{_SHEET_READ} select 'sheet:' || lower(id) as uid, 'sheet:' || lower(case depth when 1 then f when 2 then c end) as parent_uid, depth::bigint as depth, case when depth < 2 then trim(split_part(cell, '(', 1)) end as title, text
        from w where not gone qualify row_number() over (partition by id order by document, load_seq) = 1""",
    "sheet_redirects": rf"""{_SHEET_READ}, l as (select * from w where gone qualify row_number() over (partition by id order by document desc, load_seq desc) = 1)
        select id as identifier, array_to_string(list_filter(regexp_extract_all(text, '(F\d+(?:\.C\d+)?)', 1), lambda t: t <> id), ',') as targets from l""",
    "sheet_references": f"""{_SHEET_READ}, e as (select distinct 'sheet:' || lower(id) as u, refs from w where depth = 2 and not gone),
        x as (select u, trim(rtrim(split_part(split_part(refs, chr(10), 1), ': ', 2), ',')) as one, split_part(split_part(refs, chr(10), 2), ': ', 2) as two from e)
        select distinct u as source_uid, 'cat:' || one as target_uid, 'Catalog 1' as source from x join part on p_partkey::varchar = one and p_partkey % 3 > 0 union all (select distinct u, two, 'Catalog 2' from x)""",
    "mapping_tags": f"{_MAPPING} select distinct case when n = 1 then u else v end as uid, strategy, relationship from x where n = 1 or k = 1",
    "mapping_unresolved": f"{_MAPPING} select distinct number, title, case when n > 1 then k else n end as candidates from x where n <> 1 and k <> 1",
    "real_titles": "select p_partkey, case when p_partkey % 3 = 2 then trim(p_name) end as title from part",
    "published_procedures": f"""select o as control_uid, 'test' as kind, case when n % 3 = 0 then '' when f = 'A' then 'Examine: ' else 'Test: ' end || 'records of ' || p as text, 'published' as provenance, n::bigint as ord from {_LINES} as x where n % 3 < 2 and p % 4 > 0""",
    "staged_texts": """select o_orderkey as uid, concat_ws(' ', case when o_orderkey % 3 > 0 then 'Initial: ' || o_orderstatus end, case when o_orderkey % 2 > 0 then 'Managed: ' || trim(o_orderpriority) end) as text,
        concat_ws(',', case when o_orderkey % 3 > 0 then 'Initial' end, case when o_orderkey % 2 > 0 then 'Managed' end) as stages from orders""",
    "statement_texts": f"""select o as control_uid, string_agg(case when n % 2 = 0 then '' else '  ' end || case when n % 3 > 0 then n || '. ' else '' end || 'do ' || p, chr(10) order by case when n % 2 = 0 then [n] else [n - 1, n] end) as text from {_LINES} as x group by 1""",
    "folded_tables": f"""with c as (select t, r, c, trim(v) as v from ({_CELLS}) as y), u as (select * from c semi join (select distinct t, c from c where v <> '') using (t, c)),
        b as (select t, min(r) as body from (select t, r, arg_min(v, c) as first from u group by 1, 2) where first <> '' and r > 0 group by 1),
        h as (select t, c, trim(string_agg(v, ' ' order by r)) as head from u join b using (t) where r < body group by 1, 2)
        select t, r::bigint as r, string_agg(concat_ws(': ', nullif(head, ''), v), '; ' order by c) as text from u join b using (t) left join h using (t, c) where r >= body and v <> '' group by 1, 2""",
    "lettered_items": f"""with l as (select o, n, case when n % 2 = 0 then '(a) do ' || p else 'line ' || p end as x, sum((n % 2 = 0)::int) over (partition by o order by n) as item from {_LINES} as y),
        g as (select o, item, string_agg(x, ' ' order by n) as x from l group by 1, 2)
        select g.o as section, g.item::bigint as item, case when g.item > 0 then concat_ws(' ', a.x, g.x) else g.x end as text from g left join g a on a.o = g.o and a.item = 0 where g.item > 0 or not exists (select 1 from g b where b.o = g.o and b.item > 0)""",
    "mended_texts": f"select load_seq, 'multifactor within ' || p || ' days and pass- and' as text from {_LINES} as x",
}
