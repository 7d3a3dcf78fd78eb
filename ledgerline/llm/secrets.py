"""Secret scan: fixed patterns plus sliding-window entropy, in DataFrame functions only.

``secret_spans(text)`` gives, for one text column, an array of ``(start, kind_no, kind, end)`` in code
points (end exclusive), ordered by start and kind. Kinds ``assign``, ``access`` and ``hex`` come from the
fixed patterns; ``entropy`` spans are added where a candidate string holds a window whose Shannon entropy
is over the limit of its character class. A window slides over each candidate and keeps one count per
symbol: a step adds the entering symbol and takes the leaving one away, and the sum of ``c * log2(c)``
changes by these two terms alone.

Candidates of letters alone, however long, are words or names and are allow-listed, as are placeholders, UUIDs and numbers.

Defined results: a null text is an empty text; a text without a match has an empty array; repeated rows
are scanned each for themselves; only the text column is read, so other columns cannot clash. There is
no shuffle: a row's work depends on its own text alone, whatever its source or copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import free_name

# The kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "entropy")

# The base patterns. Letters of the keyword match in either case, ASCII only.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_SEEN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: A run shorter than the least length is dropped and holds no longer one, so the length can be part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Matches of a text whose spans are put together at once.
STRETCH = 64

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

#: Candidates that are never reported: placeholders, UUIDs, digits only in a tail such as a version or page number.
ALLOW = (
    r"(?i)example|sample|placeholder|dummy|changeme|redacted|x{6,}|0{8,}",
    r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    r"^[A-Za-z/_=-]*[0-9]{0,4}$",
    r"^[0-9+/_=-]*$",
)


def _spans(text: Column, pattern: str, seen: str | None = None) -> Column:
    """Array of (start, end, value) of every match: the texts between matches give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    # spans are gathered a stretch of matches at a time: a growing array is copied at each step
    zipped = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / STRETCH)), lambda k: F.slice(zipped, (k * STRETCH + 1).cast("int"), F.lit(STRETCH)))

    def gather(acc: Column, part: Column) -> Column:
        got = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out"))

    made = F.flatten(F.aggregate(stretches, F.struct(F.lit(0).alias("at"), F.slice(F.array(empty), 1, 0).alias("out")), gather, lambda acc: acc["out"]))
    made = F.when(F.size(found) > 0, made).otherwise(empty)
    return F.when(text.rlike(seen or pattern), made).otherwise(empty)


def window_entropy(token: Column, width: int) -> Column:
    """Largest Shannon entropy (bits) of the windows of ``width`` symbols of a token at least that long."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    codes = F.transform(F.split(token, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).cast("double").alias("best"), F.lit(0).alias("i"), codes.alias("codes")
    )

    def put(n: Column, code: Column, by: int) -> Column:
        return F.transform(n, lambda c, k: F.when(k == code, c + by).otherwise(c))

    def step(acc: Column, code: Column) -> Column:
        n, i = acc["n"], acc["i"]
        out = F.when(i >= width, F.get(acc["codes"], i - width)).otherwise(F.lit(-1))
        c_in = F.get(n, code)
        c_out = F.when(out >= 0, F.get(n, out) + F.when(out == code, 1).otherwise(0))
        s = acc["s"] + F.get(table, c_in + 1) - F.get(table, c_in)
        s = F.when(out >= 0, s + F.get(table, c_out - 1) - F.get(table, c_out)).otherwise(s)
        n = put(n, code, 1)
        n = F.when(out >= 0, put(n, out, -1)).otherwise(n)
        best = F.when(i >= width - 1, F.least(acc["best"], s)).otherwise(acc["best"])
        return F.struct(n.alias("n"), s.alias("s"), best.alias("best"), (i + 1).alias("i"), acc["codes"].alias("codes"))

    return F.aggregate(codes, start, step, lambda acc: F.lit(math.log2(width)) - acc["best"] / width)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, ordered by start and kind."""

    def of(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind_no"), F.lit(KINDS[k]).alias("kind"), x["end"].alias("end")))

    assign = F.filter(_spans(text, ASSIGN, ASSIGN_SEEN), lambda x: F.char_length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(of(0, assign), of(1, _spans(text, ACCESS)), of(2, _spans(text, HEX))))


def entropy_spans(text: Column, width: int = 20, hex_limit: float = 3.01, mixed_limit: float = 3.81) -> Column:
    """Spans of candidate strings that hold a window over the limit of their character class."""

    def wanted(x: Column) -> Column:
        v = x["value"]
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | v.rlike(pattern)
        limit = F.when(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(hex_limit)).otherwise(F.lit(mixed_limit))
        return F.when(allowed, F.lit(False)).otherwise(window_entropy(v, width) > limit)

    return F.transform(F.filter(_spans(text, CANDIDATE), wanted), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind_no"), F.lit(KINDS[3]).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with two array columns, ``base`` and ``added`` (entropy spans that lie in no base span).

    A column of ``docs`` that has one of these names gives way to it; ``redact`` and the query never meet that case.
    """
    t, found = F.coalesce(F.col(text), F.lit("")), free_name([*docs.columns, "base", "added"], "found")
    out = docs.drop("base", "added").withColumn("base", base_spans(t)).withColumn(found, entropy_spans(t))
    covered = f"filter({found}, x -> not exists(base, b -> b.start < x.end and x.start < b.end))"
    return out.withColumn("added", F.expr(covered)).drop(found)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replace every secret span of ``text`` by ``mark``; ``n_chars`` follows. All rows and columns stay.

    Defined results: null, empty and clean texts stay as they are, with their n_chars; repeated rows are changed alike; an empty table
    stays empty; other columns are carried along, whatever their names.
    """
    cols = docs.columns
    kept = {c: free_name(cols, f"own_{c}") for c in cols if c in ("base", "added")}
    found = scan(docs.withColumnsRenamed(kept))
    spans = "array_sort(concat(base, added))"
    rebuilt = (
        f"aggregate({spans}, named_struct('at', 0, 'out', ''), (a, x) -> "
        "if(x.end <= a.at, a, named_struct('at', x.end, 'out', concat(a.out, if(x.start < a.at, '', "
        f"concat(substring(text, a.at + 1, x.start - a.at), '{mark}'))))), "
        "a -> concat(a.out, substring(text, a.at + 1)))"
    )
    hit = found.withColumn("text", F.when(F.size("base") + F.size("added") > 0, F.expr(rebuilt)).otherwise(F.col("text")))
    return hit.withColumn("n_chars", F.when(F.size("base") + F.size("added") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*(F.col(kept.get(c, c)).alias(c) for c in cols))


def op2_secrets(docs: DataFrame) -> DataFrame:
    """The contract's row for every document: counts, digest of the base spans, all spans."""
    found = scan(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )


def oracle() -> str:
    """The same rows in DuckDB SQL; the entropy of a window is taken anew for each window."""
    quote = lambda p: p.replace("'", "''")
    allow = " or ".join(f"regexp_matches(v, '{quote(p)}')" for p in ALLOW)
    alnum = "[A-Za-z0-9+/_=-]"

    def pieces(kind: str, pattern: str) -> str:
        return f"""select r, '{kind}' as kind, unnest(m) as v, unnest(generate_series(1, len(m))) as i, m, g from
          (select r, regexp_extract_all(t, '{quote(pattern)}') as m, string_split_regex(t, '{quote(pattern)}') as g from d)"""

    at = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
    return f"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    raw as ({pieces("assign", ASSIGN)} union all {pieces("access", ACCESS)} union all {pieces("hex", HEX)} union all {pieces("entropy", f"{alnum}{{20,}}")}),
    pos as (select r, kind, v, cast({at} as bigint) as s, cast({at} as bigint) + length(v) as e from raw),
    base as (select r, kind, s, e, case kind when 'assign' then 0 when 'access' then 1 else 2 end as k from pos
      where (kind = 'assign' and length(regexp_extract(v, '{quote(ASSIGN)}', 2)) >= 6) or kind in ('access', 'hex')),
    cand as (select r, kind, s, e, v from pos where kind = 'entropy' and not ({allow})),
    ent as (select r, kind, s, e, 3 as k from cand where
      list_max(list_transform(generate_series(1, length(v) - 19), lambda i: list_entropy(string_split(substr(v, i, 20), ''))))
        > case when regexp_matches(v, '^(?:[0-9a-f]+|[0-9A-F]+)$') then 3.01 else 3.81 end
      and not exists (select 1 from base b where b.r = cand.r and b.s < cand.e and cand.s < b.e)),
    b as (select r, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as c, count(*) filter (kind = 'hex') as h,
      string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as j from base group by r),
    u as (select r, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as j, count(*) filter (k = 3) as n from (select * from base union all select * from ent) group by r)
    select doc_id, coalesce(a, 0) as n_assign, coalesce(c, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(b.j, '')) as base_sha256,
      coalesce(u.j, '') as spans, coalesce(u.n, 0) as n_entropy
    from d left join b using (r) left join u using (r)"""
