"""Tensors and matrices as tables of coordinates, two-sample distances, and summed areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import next_value, running


def unfold(t: DataFrame, mode: str, others: list[str], sizes: dict[str, int], value: str = "v") -> DataFrame:
    """(row, col, v): the matrix whose rows are one index and whose columns are the others in order."""
    col = F.lit(0).cast("long")
    for o in others:
        col = col * sizes[o] + F.col(o)
    return t.select(F.col(mode).alias("row"), col.alias("col"), value)


def fold(m: DataFrame, mode: str, others: list[str], sizes: dict[str, int], value: str = "v") -> DataFrame:
    """The tensor of an unfolded matrix."""
    rest, out = F.col("col"), {}
    for o in reversed(others):
        out[o] = rest % sizes[o]
        rest = F.floor(rest / sizes[o])
    return m.select(F.col("row").alias(mode), *[out[o].alias(o) for o in others], value)


def mode_dot(t: DataFrame, matrix: DataFrame, mode: str, value: str = "v") -> DataFrame:
    """The product of a tensor with a matrix (i, j, v) along one index: sums over j = that index."""
    m = matrix.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("v").alias("_m"))
    keep = [c for c in t.columns if c not in (mode, value)]
    joined = t.join(m, t[mode] == m["_j"])
    return joined.groupBy(F.col("_i").alias(mode), *keep).agg(F.sum(F.col(value) * F.col("_m")).alias(value))


def khatri_rao(a: DataFrame, b: DataFrame, size_b: int) -> DataFrame:
    """(i, r, v): column-wise Kronecker product of two matrices (i, r, v)."""
    x, y = a.select(F.col("i").alias("ia"), "r", F.col("v").alias("va")), b.select(F.col("i").alias("ib"), "r", F.col("v").alias("vb"))
    return x.join(y, "r").select((F.col("ia") * size_b + F.col("ib")).alias("i"), "r", (F.col("va") * F.col("vb")).alias("v"))


def from_factors(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """(i, j, k, v): the tensor of three factor matrices (i, r, v)."""
    n = lambda t, x: t.select(F.col("i").alias(x), "r", F.col("v").alias(f"v{x}"))
    j = n(a, "i").join(n(b, "j"), "r").join(n(c, "k"), "r")
    return j.groupBy("i", "j", "k").agg(F.sum(F.col("vi") * F.col("vj") * F.col("vk")).alias("v"))


def _gaps(counts: DataFrame) -> DataFrame:
    """fa, fb and step: both samples' CDFs at each distinct value, and the way to the next value."""
    t = next_value(running(counts, ["v"], {"ca": "a", "cb": "b"}, totals=True), "v", "_next")
    return t.select((F.col("ca") / F.col("ca_all")).alias("fa"), (F.col("cb") / F.col("cb_all")).alias("fb"), (F.col("_next") - F.col("v")).alias("step"))


def energy_distance_1d(df: DataFrame, group: str, value: str) -> DataFrame:
    """Energy distance of two samples (groups 0 and 1) of one variable: twice the integral of the squared gap of CDFs.

    Values are counted first; then it is one ordered pass instead of all pairs.
    """
    g = df.groupBy(F.col(value).alias("v")).agg(F.sum(F.when(F.col(group) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(group) == 1, 1).otherwise(0)).alias("b"))
    t = _gaps(g)
    return t.agg((2 * F.sum((F.col("fa") - F.col("fb")) ** 2 * F.col("step"))).alias("energy"))


def wasserstein_1d(df: DataFrame, group: str, value: str) -> DataFrame:
    """The integral of the gap between the two samples' CDFs."""
    g = df.groupBy(F.col(value).alias("v")).agg(F.sum(F.when(F.col(group) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(group) == 1, 1).otherwise(0)).alias("b"))
    t = _gaps(g)
    return t.agg(F.sum(F.abs(F.col("fa") - F.col("fb")) * F.col("step")).alias("wasserstein"))


def integral_image(pixels: DataFrame, image: str, y: str, x: str, value: str) -> DataFrame:
    """Adds `area`: the sum over all pixels above and to the left, by two running sums."""
    row = pixels.withColumn("_r", F.sum(value).over(Window.partitionBy(image, y).orderBy(x)))
    return row.withColumn("area", F.sum("_r").over(Window.partitionBy(image, x).orderBy(y))).drop("_r")
