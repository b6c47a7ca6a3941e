"""Joins by order instead of equality: the last row at or before a time, the nearest row within a caliper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """The left rows with `values` of the right row of the same `by` at the last time at or before theirs, else nulls.

    Both sides are unioned and sorted once per key, so the work is linear and no pairs are made. Of right rows with one
    key and time, the greatest values are taken. Null times on the right match nothing, on the left find nothing.
    """
    found = F.struct(*[F.col(v) for v in values])
    r = right.where(F.col(right_time).isNotNull()).groupBy(*by, F.col(right_time).alias("_t")).agg(F.max(found).alias("_r"))
    kept = [c for c in left.columns if c not in by]
    l = left.select(*by, F.col(left_time).alias("_t"), F.struct(*kept).alias("_l"))
    both = r.select(*by, "_t", "_r").unionByName(l, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first(), F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    return last.select(*by, "_l.*", *[F.col(f"_r.{v}").alias(v) for v in values])


def nearest_within(treated: DataFrame, control: DataFrame, id_col: str, score: str, caliper: float) -> DataFrame:
    """(id, match, gap): for each treated row the control with the nearest score, the smallest id among equals.

    Rows without a control within the caliper are left out; a control may serve several. Scores are cut into slices a
    caliper wide, controls go to their own and both neighbouring slices, and one sort per slice finds the next control
    on either side: linear in the rows. Equal scores count once.
    """
    width = caliper * 1.0001
    slice_ = F.floor(F.col(score) / width)
    c = control.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.min(id_col).alias("match"))
    c = c.select("s", F.struct("s", "match").alias("c"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("s") / width) + k)).alias("slice"))
    t = treated.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), slice_.alias("slice")).distinct()
    both = c.unionByName(t, allowMissingColumns=True)
    sides = [Window.partitionBy("slice").orderBy(o, F.col("c").isNull()).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("s").asc(), F.col("s").desc())]
    near = both.withColumns({f"_{k}": F.last("c", ignorenulls=True).over(w) for k, w in enumerate(sides)}).where("c is null")

    def far(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col("s") - F.col(f"{side}.s")).alias("gap"), F.col(f"{side}.match").alias("match")))

    best = near.select(F.col("s").alias("_s"), F.least(far("_0"), far("_1")).alias("_b")).where(F.col("_b.gap") <= caliper)
    return treated.join(best, F.col(score) == F.col("_s")).select(id_col, "_b.match", "_b.gap")


def treated_effect(matches: DataFrame, rows: DataFrame, id_col: str, outcome: str) -> DataFrame:
    """(att, n_matched): the mean difference in outcome between matched rows and their controls."""
    own = rows.select(F.col(id_col).alias("_i"), F.col(outcome).alias("_y"))
    mine = matches.join(own, F.col(id_col) == F.col("_i")).select("match", F.col("_y").alias("y1"))
    return mine.join(own, F.col("match") == F.col("_i")).agg(F.avg(F.col("y1") - F.col("_y")).alias("att"), F.count("*").alias("n_matched"))
