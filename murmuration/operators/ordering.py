"""Places, running sums and percentiles in a total order, without sending all rows through one task.

Rows are range-sorted into as many parts as the session shuffles to and written once, so that every reader sees the same
parts. Parts are summed, the few sums are added up from part to part, and inside a part a window does the rest.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize

PART = "_part"


def _columns(order: list) -> dict[str, Column]:
    return {f"_o{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(order)}


def _ranged(df: DataFrame, order: list, by: list[str]) -> tuple[DataFrame, list[str]]:
    keyed = df.withColumns(_columns(order))
    keys = [f"_o{i}" for i in range(len(order))]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = keyed.repartitionByRange(parts, *by, *keys) if by or keys else keyed.repartition(1)
    return materialize(ranged.withColumn(PART, F.spark_partition_id()), "ranges"), keys


def _joined(ranged: DataFrame, per_part: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the sums of their part; one row per part and group."""
    named = per_part.select(*[F.col(g).alias(f"_g_{g}") for g in by], F.col(PART).alias("_g_part"), *[c for c in per_part.columns if c not in (*by, PART)])
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in by] + [F.col(PART) == F.col("_g_part")]
    # Without groups there are as many rows as parts; groups can be many, and then the join shuffles.
    named = named if by else F.broadcast(named)
    return ranged.join(named, reduce(and_, same)).drop("_g_part", *[f"_g_{g}" for g in by])


def numbered(df: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """Adds `_at`, the place from 0 in an ascending order (nulls first), and `_n`, the number of rows; within `by`.

    `order` has to tell rows apart for repeatable places; rows that it does not tell apart stand in one part.
    """
    by = by or []
    ranged, keys = _ranged(df, order, by)
    counts = ranged.groupBy(*by, PART).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    before = counts.withColumns({"_before": F.sum("_c").over(upto) - F.col("_c"), "_n": F.sum("_c").over(group)}).drop("_c")
    inside = Window.partitionBy(*by, PART).orderBy(*keys)
    return _joined(ranged, before, by).withColumn("_at", F.row_number().over(inside) - 1 + F.col("_before")).drop(*keys, PART, "_before")


def running(df: DataFrame, order: list, sums: dict[str, str], by: list[str] | None = None, totals: bool = False) -> DataFrame:
    """Adds `out: column` inclusive running sums in an ascending order, within `by`; with `totals` also `out_all`."""
    by = by or []
    ranged, keys = _ranged(df, order, by)
    per = ranged.groupBy(*by, PART).agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
    group = Window.partitionBy(*by)
    earlier = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(
        *by, PART, *[F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_b_{o}") for o in sums],
        *[F.sum(f"_s_{o}").over(group).alias(f"{o}_all") for o in sums if totals],
    )
    inside = Window.partitionBy(*by, PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    found = _joined(ranged, before, by).withColumns({o: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_b_{o}") for o, c in sums.items()})
    return found.drop(*keys, PART, *[f"_b_{o}" for o in sums])


def next_value(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the next larger value of a column of distinct values; null after the last.

    Inside a part by a window; the last row of a part takes the least value of the parts after it.
    """
    ranged, _ = _ranged(df, [column], [])
    least = ranged.groupBy(PART).agg(F.min(column).alias("_m"))
    later = Window.partitionBy().orderBy(PART).rowsBetween(1, Window.unboundedFollowing)
    after = least.select(PART, F.min("_m").over(later).alias("_after"))
    inside = F.lead(column).over(Window.partitionBy(PART).orderBy(column))
    return _joined(ranged, after, []).withColumn(out, F.coalesce(inside, F.col("_after"))).drop("_o0", PART, "_after")


def percentiles(df: DataFrame, columns: dict[str, Column], points: list[float], nans: bool = False) -> dict[str, list[float | None]]:
    """Exact percentiles of columns by linear interpolation between ranks; null and NaN values are left out.

    With `nans` NaN counts as the greatest value, as in Spark's and DuckDB's own order.

    Values are counted first, so that repeated ones cost a row; counts are added up in the order of the values, and only
    the rows at the wanted ranks come to the driver.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("f"), c.cast("double").alias("v")) for name, c in columns.items()])
    flat = df.select(F.explode(cells).alias("e")).select("e.f", "e.v").where("v is not null" if nans else "v is not null and not isnan(v)")
    counts = running(flat.groupBy("f", "v").agg(F.count("*").alias("c")), ["v"], {"upto": "c"}, ["f"], totals=True)
    low = [F.floor((F.col("upto_all") - 1) * F.lit(float(p))) for p in points]
    ranks = F.array(*low, *[F.least(x + 1, F.col("upto_all") - 1) for x in low])
    hit = F.exists(ranks, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("c")))
    found: dict[str, list] = {name: [] for name in columns}
    for r in counts.where(hit).select("f", "v", "c", "upto", "upto_all").collect():
        found[r.f].append(r)

    def at(rows: list, rank: int) -> float:
        return next(r.v for r in rows if r.upto - r.c <= rank < r.upto)

    out: dict[str, list[float | None]] = {}
    for name, rows in found.items():
        n = rows[0].upto_all if rows else 0
        out[name] = []
        for p in points:
            place = (n - 1) * p
            k = math.floor(place)
            if not rows:
                out[name].append(None)
                continue
            a, b = at(rows, k), at(rows, min(k + 1, n - 1))
            out[name].append(a if place == k else a + (b - a) * (place - k))
    return out
