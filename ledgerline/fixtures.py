"""Control tables for the registered queries, derived from the given tables by SQL that any engine reads.

Each entry of ``SQL`` is plain SQL over the given tables. ``frame`` runs it in Spark; other engines run the text itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_N = "cast(l_quantity as int)"
_CASE = "case (l_orderkey + l_linenumber) % 8"

SQL = {
    # documents as controls: a framework for each source
    "controls": """select concat(source, ':', cast(doc_id as varchar(20))) as uid, source as framework_key, left(text, 60) as title, text,
        source as section_ref, doc_id % 50 = 0 as structural, doc_id as load_seq from documents""",
    "queries": "select item_id as query_id, text from benchmark",
    # tier by source number modulo five, a sixth of the sources without one
    "frameworks": """select source as framework_key, case when n % 6 = 5 then null else 1 + n % 5 end as tier, n % 5 as jurisdiction, n % 3 as intra_order,
        case when n % 3 > 0 then concat('family', cast(n % 7 as varchar(20))) end as family, concat('Short ', source) as short_name, n % 4 <> 0 as permissive from (select distinct source, cast(substring(source, 4) as int) as n from documents)""",
    # requirement texts, one for each line item, by template
    "requirements": f"""select concat('fw', cast(l_suppkey % 10 as varchar(20)), ':', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20))) as uid,
        concat('fw', cast(l_suppkey % 10 as varchar(20))) as framework_key, l_orderkey as subject_id, l_orderkey * 10 + l_linenumber as load_seq,
        concat({_CASE}
          when 0 then 'The system owner must review access records within ' when 1 then 'Operators must not retain session tokens for more than '
          when 2 then 'Logs shall be kept for at least ' when 3 then 'Administrators should rotate keys at least every '
          when 4 then 'Passwords may contain a minimum of ' when 5 then 'Backups are tested every ' when 6 then 'Section ' else 'Reports are published. A maximum period of ' end,
          cast({_N} as varchar(20)), {_CASE}
          when 0 then ' days of a change.' when 1 then ' hours.' when 2 then ' months (60 days).' when 3 then ' days and no later than twenty-four hours after disclosure.'
          when 4 then concat(' characters; keys exceed ', cast({_N} * 8 as varchar(20)), ' bits.') when 5 then ' weeks, 24 hours per day.'
          when 6 then ' general provisions' else ' minutes applies to outages.' end) as text from lineitem""",
    # identifiers as printed, and what people type for them
    "printed_ids": """select concat('AB-', lpad(cast(l_orderkey as varchar(20)), 8, '0'), '(', cast(l_linenumber as varchar(20)), ')') as identifier,
        concat('fw', cast(l_suppkey % 10 as varchar(20))) as framework_key, l_orderkey, l_linenumber from lineitem""",
    "typed_ids": """select cast(l_orderkey as varchar(20)) || '/' || cast(l_linenumber as varchar(20)) as query_id, case l_linenumber % 5
        when 0 then concat('ab ', cast(l_orderkey as varchar(20)), '.', cast(l_linenumber as varchar(20)))
        when 1 then concat('AB-', cast(l_orderkey as varchar(20)), '[', cast(l_linenumber as varchar(20)), ']')
        when 2 then concat('  AB - ', cast(l_orderkey as varchar(20)), ' (', cast(l_linenumber as varchar(20)), ')')
        when 3 then concat(cast(l_orderkey as varchar(20)), '.', cast(l_linenumber as varchar(20)))
        else 'multi-factor authentication' end as query from lineitem""",
    # a chain of five levels
    "hierarchy": """select concat('r', cast(r_regionkey as varchar(20))) as uid, cast(null as varchar(30)) as parent_uid, r_name as text, 0 as depth from region
        union all select concat('n', cast(n_nationkey as varchar(20))), concat('r', cast(n_regionkey as varchar(20))), n_name, 1 from nation
        union all select concat('c', cast(c_custkey as varchar(20))), concat('n', cast(c_nationkey as varchar(20))), case when c_custkey % 3 = 0 then concat(c_name, ':') else c_name end, 2 from customer
        union all select concat('o', cast(o_orderkey as varchar(20))), concat('c', cast(o_custkey as varchar(20))), case when o_orderkey % 2 = 0 then concat('order ', o_orderstatus) else concat('Order ', o_orderstatus) end, 3 from orders
        union all select concat('l', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20))), concat('o', cast(l_orderkey as varchar(20))), concat('line ', min(l_returnflag)), 4 from lineitem group by l_orderkey, l_linenumber""",
    # typed links part -> supplier; the first of each pair
    "links": """select concat('p', cast(l_partkey % 10 as varchar(20)), ':', cast(l_partkey as varchar(20))) as source_uid, concat('s', cast(l_suppkey % 4 as varchar(20)), ':', cast(l_suppkey as varchar(20))) as target_uid,
        case l_returnflag when 'A' then 'published' when 'N' then 'published-tag' else 'derived' end as provenance,
        case when l_linestatus = 'F' then 'relates' when l_linenumber % 2 = 0 then 'incorporates' else 'aligns-with' end as kind,
        case when l_linenumber % 7 = 0 or l_returnflag = 'R' then null else concat('s', cast(l_suppkey % 4 as varchar(20))) end as asserted_by,
        l_orderkey * 10 + l_linenumber as load_seq from lineitem""",
}


def text_of(name: str) -> str:
    return SQL[name]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``SQL``, or one of the given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SQL[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\bfrom {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", sql)
    return spark.sql(sql, **used)
