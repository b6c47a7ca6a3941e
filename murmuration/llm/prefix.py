"""Running sums over groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, groups: list[str], bucket: str, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds `out: value` inclusive running sums of columns, by bucket, then `order`, within `groups`.

    Two levels: totals per bucket, prefix sums of those, and running sums inside each bucket, so a task holds one
    bucket of a group and never the whole group.
    """
    keys = [*groups, bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(f"_sum_{o}") for o, v in sums.items()])
    up_to = Window.partitionBy(*groups).orderBy(bucket)
    offsets = totals.select(
        *[F.col(k).alias(f"_at_{k}") for k in keys],
        *[(F.sum(f"_sum_{o}").over(up_to) - F.col(f"_sum_{o}")).alias(f"_before_{o}") for o in sums],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    joined = df.join(offsets, reduce(and_, same), "left").drop(*[f"_at_{k}" for k in keys])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *df.columns, *[(F.sum(v).over(inside) + F.col(f"_before_{o}")).alias(o) for o, v in sums.items()]
    )
