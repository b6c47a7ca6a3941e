"""Baselines, active learning, acquisition, calibration by bins, prediction sets and local effects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize
from .ordering import numbered, percentiles
from .preprocessing import bin_edges, bin_index


def dummy_class(df: DataFrame, label: str) -> Column:
    """The most frequent label (smallest of ties)."""
    return F.lit(df.groupBy(label).count().orderBy(F.desc("count"), label).first()[label])


def dummy_value(df: DataFrame, target: str, strategy: str = "mean", quantile: float = 0.5) -> Column:
    """The mean, median or exact quantile of a column, as one value for every row; no task gets all values to order."""
    if strategy == "mean":
        return F.lit(df.agg(F.avg(target)).first()[0])
    return F.lit(percentiles(df, {"t": F.col(target)}, [{"median": 0.5, "quantile": quantile}[strategy]], nans=True)["t"][0])


def uncertainty(p: Column) -> Column:
    """One less the largest probability of an array."""
    return 1 - F.array_max(p)


def margin(p: Column) -> Column:
    """The gap between the two largest probabilities."""
    s = F.sort_array(p, asc=False)
    return s[0] - s[1]


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def query_rows(df: DataFrame, score: Column, id_col: str, n: int) -> DataFrame:
    """The n rows with the greatest score, ties by id."""
    return df.withColumn("_score", score).orderBy(F.desc("_score"), id_col).limit(n).drop("_score")


def _pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def upper_confidence_bound(mean: Column, std: Column, kappa: float = 2.0) -> Column:
    return mean + kappa * std


def probability_of_improvement(mean: Column, std: Column, best: float, xi: float = 0.01) -> Column:
    from ..functions.distributions import normal_cdf_column

    return F.when(std > 0, normal_cdf_column((mean - best - xi) / std)).otherwise(0.0)


def expected_improvement(mean: Column, std: Column, best: float, xi: float = 0.01) -> Column:
    from ..functions.distributions import normal_cdf_column

    z = (mean - best - xi) / std
    return F.when(std > 0, (mean - best - xi) * normal_cdf_column(z) + std * _pdf(z)).otherwise(0.0)


def histogram_binning(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """Adds `calibrated`: the share of positives in the bin of a probability; an empty bin gives its middle."""
    fit = df.select(F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int").alias("_b"), F.col(y).alias("_y")).groupBy("_b").agg(F.avg("_y").alias("_v"))
    at = F.greatest(F.ceil(F.col(p) * n_bins) - 1, F.lit(0)).cast("int")
    joined = df.withColumn("_at", at).join(F.broadcast(fit), F.col("_at") == F.col("_b"), "left")
    return joined.withColumn("calibrated", F.coalesce("_v", (F.col("_at") + 0.5) / n_bins)).drop("_at", "_b", "_v")


def set_size_threshold(df: DataFrame, probabilities: Column, label: Column, alpha: float = 0.1) -> float:
    """The 1 - alpha percentile of the sorted probability mass down to the true class."""
    order = F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p).alias("n"), i.alias("i"))))
    own = F.element_at(probabilities, label + 1)
    mass = F.aggregate(order, F.lit(0.0), lambda s, e: s + F.when((e["n"] < -own) | ((e["n"] == -own) & (e["i"] <= label)), -e["n"]).otherwise(0.0))
    return percentiles(df, {"m": mass}, [1 - alpha], nans=True)["m"][0]


def prediction_set(probabilities: Column, threshold: float) -> Column:
    """The classes of the shortest prefix, from the most probable, whose mass reaches the threshold."""
    order = F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p).alias("n"), i.alias("i"))))
    kept = F.aggregate(
        order,
        F.struct(F.lit(0.0).alias("m"), F.array().cast("array<int>").alias("c")),
        lambda s, e: F.when(s["m"] < threshold, F.struct((s["m"] - e["n"]).alias("m"), F.array_append(s["c"], e["i"]).alias("c"))).otherwise(s),
    )
    return kept["c"]


def accumulated_effects(df: DataFrame, feature: str, predict, n_bins: int = 20) -> DataFrame:
    """(bin, n, effect): accumulated local effects of a feature on a column function of it, centred over the bins."""
    edges = bin_edges(df, feature, n_bins)
    b = bin_index(F.col(feature).cast("double"), edges)
    e = F.array(*[F.lit(float(x)) for x in edges])
    low, high = F.element_at(e, b + 1), F.element_at(e, b + 2)
    g = df.select(b.alias("bin"), (predict(high) - predict(low)).alias("d")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("d").alias("d"))
    a = g.withColumn("a", F.sum("d").over(Window.orderBy("bin")))
    return a.select("bin", "n", (F.col("a") - F.avg("a").over(Window.partitionBy())).alias("effect"))


def permutation_importance(df: DataFrame, id_col: str, columns: list[str], y: str, predict, score, seed: int = 0) -> DataFrame:
    """(feature, drop): how much the score falls when one column's values are dealt out anew among the rows.

    Values move from a row's place in id order to the one of its place in the order of a digest, so a rerun is the same.
    `predict` makes the prediction column from the features by name, `score` the aggregate of truth and prediction.
    """
    base = df.agg(score(F.col(y), predict())).first()[0]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    plain = numbered(df.select(id_col, y, *columns), [id_col]).withColumnRenamed("_at", "_p").drop("_n")
    dealt = numbered(df.select(id_col, *[F.col(c).alias(f"_dealt_{c}") for c in columns]), [digest, id_col]).select(F.col("_at").alias("_p"), *[f"_dealt_{c}" for c in columns])
    both = materialize(plain.join(dealt, "_p"), "dealt")
    rows = []
    for c in columns:
        fallen = both.withColumn(c, F.col(f"_dealt_{c}")).agg(score(F.col(y), predict())).first()[0]
        rows.append((c, float(base - fallen)))
    return df.sparkSession.createDataFrame(rows, "feature string, drop double")
