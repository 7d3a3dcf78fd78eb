"""Ordered scans: what stands above a row in its group, for groups of any length.

A window over a group puts the whole group into one task. Here the rows are dealt by ranges of (group, order), so that a long group lies
in many parts. Each part is scanned for itself; what a part leaves behind (its last values and its sums) is carried over to the parts
after it, which is a window over one row a group and part; and each row takes its own part's value, or else the carried one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.common import RULES, materialise


def ordered_scan(rows: DataFrame, group: list[str], order: list[str | Column], fills: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with a column for each of ``fills``, the last value that isn't null at or above the row, and of ``sums``, the sum up to it.

    A fill that is a struct of nulls counts as a value: it ends what stood above. Rows that are equal in ``order`` come in any order, the
    same one for all columns. A null group is a group.
    """
    fills, sums = fills or {}, sums or {}
    own = [F.col(g) for g in group]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    made = rows.withColumns({f"__scan_f_{k}": v for k, v in fills.items()} | {f"__scan_s_{k}": F.coalesce(v.cast("long"), F.lit(0)) for k, v in sums.items()})
    dealt = made.repartitionByRange(*own, *order).sortWithinPartitions(*own, *order).withColumn("__scan_at", F.monotonically_increasing_id())
    dealt = materialise(dealt.withColumn("__scan_part", F.shiftrightunsigned("__scan_at", 33)))

    left = dealt.groupBy(*own, "__scan_part").agg(
        *[F.max_by(f"__scan_f_{k}", F.when(F.col(f"__scan_f_{k}").isNotNull(), F.col("__scan_at"))).alias(f"__scan_f_{k}") for k in fills], *[F.sum(f"__scan_s_{k}").alias(f"__scan_s_{k}") for k in sums], F.count(F.lit(1)).alias("__scan_n")
    )
    before = Window.partitionBy(*own).orderBy("__scan_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select(
        *[c.alias(f"__scan_g_{g}") for g, c in zip(group, own, strict=True)], F.col("__scan_part").alias("__scan_p"),
        *[F.last(f"__scan_f_{k}", ignorenulls=True).over(before).alias(f"__scan_c_{k}") for k in fills], *[F.sum(f"__scan_s_{k}").over(before).alias(f"__scan_c_{k}") for k in sums],
    )
    # only a group's later parts get anything: a row for each part that a group runs on into
    first = Window.partitionBy(*[f"__scan_g_{g}" for g in group]).orderBy("__scan_p")
    carried = materialise(carried.withColumn("__scan_i", F.row_number().over(first)).where("__scan_i > 1").drop("__scan_i"))
    if carried.limit(RULES + 1).count() <= RULES:
        carried = F.broadcast(carried)

    inside = Window.partitionBy(*own, "__scan_part").orderBy("__scan_at").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({f"__scan_l_{k}": F.last(f"__scan_f_{k}", ignorenulls=True).over(inside) for k in fills} | {f"__scan_l_{k}": F.sum(f"__scan_s_{k}").over(inside) for k in sums})
    same = F.col("__scan_part") == F.col("__scan_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__scan_g_{g}"))
    out = local.join(carried, same, "left")
    got = {k: F.coalesce(f"__scan_l_{k}", f"__scan_c_{k}") for k in fills} | {k: F.col(f"__scan_l_{k}") + F.coalesce(f"__scan_c_{k}", F.lit(0)) for k in sums}
    return out.select(*[c for c in rows.columns if c not in got], *[v.alias(k) for k, v in got.items()])


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "nth") -> DataFrame:
    """``rows`` with their number, from 1, in the order of their group."""
    return ordered_scan(rows, group, order, sums={name: F.lit(1)})
