"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its share of all words, stopped at ``cap`` times what it holds; what is cut off goes
to the others by weight. That sharing has a closed form: with the sources ordered by
``cap * words / weight``, those before some place are stopped and the rest take equal words a weight.

Inside a source the expected copies of a document are ``min(cap, k * w)``, where the weight ``w`` grows with
the bit length of the document's size (long documents are a little likelier than short ones) and ``k`` makes
the expected words equal to the target; there are at most 64 such weights, so ``k`` comes from a few rows a
source. Whole copies are certain. The fraction left is the inclusion probability ``p`` of one more copy:
documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a keyed digest, and each source takes
the first ones up to a fixed number of words (its target less the certain words), the last one only if
that brings the total nearer.

No source is ever sorted whole: the ranks are counted in bins, two levels deep, and only documents of the
one bin in which a source's count ends are put in order, so a source may hold any part of all rows.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, last in
order; repeated rows take part each for themselves, in a defined order; an empty table gives no rows; with
no words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import free_name, materialise, null_join

# Fixed value: what a word is (runs of anything but space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (1, 2, 3)
BINS = 4096
SALTS = 64


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: float = 3.0) -> DataFrame:
    """One row a source: (source, source_size, target). ``sizes`` holds (source, size).

    The weights go round by the sources' order, so the sources (not their documents) are put in one order: a row of some 50 bytes each.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.get(F.array(*[F.lit(float(c)) for c in cycle]), (F.row_number().over(order) - 1) % len(cycle)))
    by = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumns(
        {
            "all_words": F.sum("source_size").over(whole),
            "stopped": cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "weight_left": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    per = per.withColumn("level", (F.col("all_words") - F.col("stopped")) / F.col("weight_left"))
    # the first source that its share doesn't fill up sets the words a weight for itself and all after it
    per = per.withColumn("fits", F.col("level") * F.col("w") <= cap * F.col("source_size"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("stopped"), F.col("level")))).over(whole)["level"]
    share = F.coalesce(level * F.col("w"), F.lit(0.0))
    return per.withColumn("target", F.least(cap * F.col("source_size"), share).cast("double")).select("source", "source_size", "target")


def unit_draw(key: Column, seed: int) -> Column:
    """Uniform in (0, 1), from the digest of a key: the same at every run and in any engine that has MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _key() -> Column:
    return F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string"))


def mix(docs: DataFrame, seed: int = 7, cycle: tuple[int, ...] = CYCLE, cap: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of ``docs(doc_id, text, source)``."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialise(rows)  # the texts are read once; what follows works on 20 bytes a document
    of = targets(rows, cycle, float(cap))
    bits = F.length(F.bin("size")).cast("double")

    # k of each source: levels in falling order of weight stop at cap copies, the rest share by weight
    level = rows.where("size > 0").groupBy("source", bits.alias("b")).agg(F.sum("size").alias("z"))
    level = null_join(level, of, ["source"])
    w = Window.partitionBy("source")
    down = w.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumns(
        {
            "stopped": cap * F.coalesce(F.sum("z").over(down), F.lit(0)),
            "left": F.sum(F.col("z") * F.col("b")).over(w) - F.coalesce(F.sum(F.col("z") * F.col("b")).over(down), F.lit(0.0)),
        }
    )
    level = level.withColumn("k", (F.col("target") - F.col("stopped")) / F.col("left")).where(F.col("k") * F.col("b") <= cap)
    of_k = level.groupBy("source").agg(F.max_by("k", "b").alias("k"))
    plan = null_join(of, of_k, ["source"], "left")

    # a row a source on the right; the rows of a hot source are dealt over many tasks
    drawn = null_join(rows, plan, ["source"], salts=SALTS)
    copies = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.coalesce(F.least(F.lit(float(cap)), F.col("k") * bits), F.lit(float(cap))))
    drawn = drawn.withColumn("e", copies).withColumn("sure", F.floor("e").cast("int")).withColumn("p", F.col("e") - F.col("sure"))
    u = unit_draw(_key(), seed)
    odds = (u / (1 - u)) * ((1 - F.col("p")) / F.col("p"))
    drawn = drawn.withColumn("q", F.when(F.col("p") > 0, odds / (1 + odds)))
    drawn = materialise(drawn.withColumn("bin", F.floor(F.col("q") * (BINS * BINS)).cast("long")))

    room = drawn.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("sure"))).alias("room"))
    fine = drawn.where("q is not null").groupBy("source", (F.floor(F.col("bin") / BINS)).alias("coarse")).agg(F.sum("size").alias("z"))
    run = Window.partitionBy("source").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    cut = _cut(fine.withColumn("before", F.coalesce(F.sum("z").over(run), F.lit(0))), room, "coarse")

    inner = drawn.where("q is not null").withColumn("coarse", F.floor(F.col("bin") / BINS))
    inner = null_join(inner, cut.withColumnRenamed("at", "coarse"), ["source", "coarse"], salts=SALTS).groupBy("source", "bin").agg(F.sum("size").alias("z"), F.first("before").alias("base"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    last = _cut(inner.withColumn("before", F.col("base") + F.coalesce(F.sum("z").over(run), F.lit(0))), room, "bin")

    # a source without a last bin takes every extra copy (its room is not less than all of them) or none at all
    all_or_none = F.when(F.col("room") > 0, F.lit(BINS * BINS + 1)).otherwise(F.lit(-1))
    ends = null_join(room, last, ["source"], "left").withColumn("at", F.coalesce("at", all_or_none).cast("long"))
    placed = null_join(drawn, ends, ["source"], salts=SALTS)
    edge = placed.where("bin = at")
    inside = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("extra", F.when(F.col("room") - F.col("so_far") > F.col("so_far") + F.col("size") - F.col("room"), 1).otherwise(0))
    rest = placed.where("bin is null or bin <> at").withColumn("extra", F.when(F.col("bin") < F.col("at"), 1).otherwise(0))
    keep = ["doc_id", "source", "size", "source_size", "target"]
    out = rest.select(*keep, "sure", "extra").union(edge.select(*keep, "sure", "extra"))
    return out.select(*keep, (F.col("sure") + F.col("extra")).alias("copies"))


def _cut(counted: DataFrame, room: DataFrame, bin_name: str) -> DataFrame:
    """Of each source, the bin in which the words before it don't fill the room, but those with it do."""
    found = null_join(counted, room, ["source"]).where("before < room and before + z >= room")
    return found.select("source", F.col(bin_name).alias("at"), "before")


def op6_mix(docs: DataFrame) -> DataFrame:
    """The contract's row for every document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def repeat_taken(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` as the mix takes them: each document as many times as it has copies; columns unchanged.

    Decisions belong to (doc_id, source, size); repeated rows with different copies share them in the order of their texts. Defined
    results: null and empty texts go (they have no words to take); a null doc_id or source is a key like any other; an empty table
    stays empty; other columns are carried along, whatever their names.
    """
    cols = docs.columns
    taken = mix(docs.select("doc_id", "text", "source"), seed).where("copies > 0")
    size, nth, copies, copy = (free_name(cols, x) for x in ("size", "nth", "copies", "copy"))
    key = ["doc_id", "source", size]
    taken = taken.select("doc_id", "source", F.col("size").alias(size), F.col("copies").alias(copies))
    taken = taken.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(F.col(copies).desc())))
    sized = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).where(F.col(size) > 0)
    sized = sized.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy("text")))
    out = null_join(sized, taken, [*key, nth])
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*cols)


def oracle(seed: int = 7) -> str:
    """The same rows in DuckDB SQL, each source sorted whole."""
    return f"""
    with recursive r as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents),
    per as (select source, sum(size)::bigint as z, row_number() over (order by source nulls last) as n from r group by source),
    pw as (select source, z, [1.0::double, 2.0::double, 3.0::double][(n - 1) % 3 + 1] as w from per),
    c as (select *, sum(z) over () as total, 3.0::double * coalesce(sum(z) over (order by z / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as stopped,
      sum(w) over () - coalesce(sum(w) over (order by z / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as wl from pw),
    l as (select *, (total - stopped) / wl as level from c),
    lv as (select level from l where level * w <= 3.0::double * z order by stopped, level limit 1),
    t as (select source, z as source_size, least(3.0::double * z, coalesce((select level from lv) * w, 0)) as target from l),
    d as (select r.*, source_size, target, length(bin(size))::double as b from r join t on r.source is not distinct from t.source),
    bl as (select source, b, sum(size)::bigint as z, any_value(target) as target from d where size > 0 group by source, b),
    bs as (select *, 3 * coalesce(sum(z) over (partition by source order by b desc rows between unbounded preceding and 1 preceding), 0) as stopped,
      sum(z * b) over (partition by source) - coalesce(sum(z * b) over (partition by source order by b desc rows between unbounded preceding and 1 preceding), 0) as lft from bl),
    bk as (select source, max_by((target - stopped) / lft, b) as k from bs where (target - stopped) / lft * b <= 3 group by source),
    e as (select d.*, case when size = 0 then 0.0::double else coalesce(least(3.0::double, k * b), 3.0::double) end as e from d left join bk on d.source is not distinct from bk.source),
    s as (select *, floor(e)::int as sure, e - floor(e) as p,
      (('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '-') || '/' || size), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u from e),
    o as (select *, case when p > 0 then (u / (1 - u)) * ((1 - p) / p) end as odds from s),
    q as (select *, odds / (1 + odds) as q, target - sum(size * sure) over (partition by source) as room from o),
    f as (select *, coalesce(sum(size) over (partition by source order by q nulls last, doc_id, size rows between unbounded preceding and 1 preceding), 0) as so_far from q)
    select doc_id, size, source_size, target,
      (size * (sure + case when q is not null and so_far < room and room - so_far > so_far + size - room then 1 else 0 end))::bigint as taken from f"""
