"""Encoders of a category by what a target does in it.

A fitted encoder is a table (category, value, ...) plus the value of unseen categories. The join is broadcast where
Spark finds the table small, and shuffles where it is not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize, sized
from .ordering import running


@dataclass(frozen=True)
class CategoryTable:
    table: DataFrame
    unseen: float | None

    def transform(self, df: DataFrame, column: str, out: str = "encoded") -> DataFrame:
        t = self.table.select(F.col("category").alias("_category"), F.col("value").alias("_value"))
        joined = df.join(t, F.col(column) == F.col("_category"), "left")
        return joined.withColumn(out, F.coalesce("_value", F.lit(self.unseen))).drop("_category", "_value")


def _groups(df: DataFrame, column: str, y: Column | None = None) -> DataFrame:
    y = F.lit(0.0) if y is None else y
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(
        F.count("*").alias("n"), F.sum(y).alias("s"), F.avg(y).alias("m"), F.var_pop(y).alias("v")
    )


def _global(df: DataFrame, y: Column):
    r = df.agg(F.avg(y).alias("m"), F.var_pop(y).alias("v"), F.count(y).alias("n"), F.sum(y).alias("s")).first()
    return r


def fit_m_estimate(df: DataFrame, column: str, y: Column, m: float = 1.0) -> CategoryTable:
    """(n * mean + m * global mean) / (n + m)."""
    g = _global(df, y).m
    return CategoryTable(_groups(df, column, y).withColumn("value", (F.col("s") + m * g) / (F.col("n") + m)), g)


def fit_target(df: DataFrame, column: str, y: Column, smoothing: float = 10.0) -> CategoryTable:
    return fit_m_estimate(df, column, y, smoothing)


def fit_woe(df: DataFrame, column: str, y: Column, smoothing: float = 0.5) -> CategoryTable:
    """Weight of evidence of a 0/1 target; unseen categories have none."""
    g = _global(df, y)
    pos, neg = F.col("s"), F.col("n") - F.col("s")
    value = F.ln(((pos + smoothing) / F.lit(float(g.s))) / ((neg + smoothing) / F.lit(float(g.n - g.s))))
    return CategoryTable(_groups(df, column, y).withColumn("value", value), 0.0)


def fit_james_stein(df: DataFrame, column: str, y: Column) -> CategoryTable:
    """Category means shrunk to the global mean by the share of variance between categories."""
    g, groups = _global(df, y), _groups(df, column, y)
    between = groups.agg(F.var_pop("m")).first()[0] or 0.0
    weight = F.when(F.lit(between) + F.lit(g.v) / F.col("n") > 0, between / (between + F.lit(g.v) / F.col("n"))).otherwise(1.0)
    return CategoryTable(groups.withColumn("value", weight * F.col("m") + (1 - weight) * g.m), g.m)


def fit_count(df: DataFrame, column: str, normalize: bool = False) -> CategoryTable:
    n = df.count() if normalize else 1
    return CategoryTable(_groups(df, column).withColumn("value", F.col("n") / F.lit(float(n))), 0.0)


def leave_one_out(df: DataFrame, column: str, y: str, out: str = "encoded") -> DataFrame:
    """The mean of the target over the other rows of the category; a single row gets the global mean."""
    g = df.agg(F.avg(y)).first()[0]
    per = sized(materialize(df.groupBy(F.col(column).alias("_key")).agg(F.sum(y).alias("_s"), F.count("*").alias("_n")), "categories"))
    joined = df.join(per, F.col(column).eqNullSafe(F.col("_key")), "left")
    others = (F.col("_s") - F.col(y)) / (F.col("_n") - 1)
    return joined.withColumn(out, F.when(F.col("_n") > 1, others).otherwise(F.lit(g))).drop("_key", "_s", "_n")


def ordered_target_statistic(df: DataFrame, column: str, y: str, order: list, prior_weight: float = 1.0, prior: float | None = None, out: str = "encoded") -> DataFrame:
    """The smoothed mean over the rows of the category that come earlier in a given order."""
    prior = df.agg(F.avg(y)).first()[0] if prior is None else prior
    counted = df.withColumns({"_v": F.coalesce(F.col(y).cast("double"), F.lit(0.0)), "_k": F.col(y).isNotNull().cast("long")})
    seen = running(counted, order, {"_s": "_v", "_n": "_k"}, [column])
    s, n = F.col("_s") - F.col("_v"), F.col("_n") - F.col("_k")
    return seen.withColumn(out, (s + prior * prior_weight) / (n + prior_weight)).drop("_v", "_k", "_s", "_n")


def rare_labels(df: DataFrame, column: str, tol: float = 0.01, label: str = "Rare") -> DataFrame:
    """Categories with a smaller share than `tol` under one label."""
    shares = fit_count(df, column, normalize=True).transform(df, column, "_share")
    return shares.withColumn(column, F.when(F.col("_share") >= tol, F.col(column)).otherwise(label)).drop("_share")


def binary_encode(df: DataFrame, column: str) -> DataFrame:
    """The bits of a category's sorted number, from 1; unseen is 0."""
    from .preprocessing import categories

    table = categories(df, column)
    n = table.count()
    bits = max(1, n.bit_length()) if n else 1
    joined = df.join(sized(table, n), F.col(column) == F.col("category"), "left")
    code = F.coalesce(F.col("code") + 1, F.lit(0)).cast("int")
    return joined.withColumns({f"{column}_b{b}": F.shiftright(code, b).bitwiseAND(F.lit(1)) for b in range(bits - 1, -1, -1)}).drop("category", "code")


def deep_features(df: DataFrame, key: str, columns: list[str], primitives=("mean", "std", "max", "min", "count")) -> DataFrame:
    """Aggregates of each entity, joined back to its rows."""
    f = {"mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min, "sum": F.sum, "median": F.median}
    aggs = [f[p](c).alias(f"{c}_{p}") for c in columns for p in primitives if p != "count"]
    aggs += [F.count("*").alias("n_rows")] if "count" in primitives else []
    per = df.groupBy(F.col(key).alias("_key")).agg(*aggs)
    return df.join(per, F.col(key) == F.col("_key"), "left").drop("_key")


def feature_hash(df: DataFrame, id_col: str, map_col: str, n_features: int = 1024, alternate_sign: bool = True) -> DataFrame:
    """(id, feature, value): the entries of a map column summed into hashed features, with a sign by hash."""
    flat = df.select(id_col, F.explode(map_col).alias("k", "v"))
    h = F.xxhash64("k")
    sign = F.when(F.shiftright(h, 62).bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0) if alternate_sign else F.lit(1.0)
    return flat.groupBy(id_col, F.pmod(h, F.lit(n_features)).cast("int").alias("feature")).agg(F.sum(sign * F.col("v")).alias("value"))
