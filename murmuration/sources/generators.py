"""Made-up tables of any size, from a range: each executor makes its own rows, and a seed gives the same rows again."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, salt: int):
    """A number in [0, 1) from the row's id, the same in every run and partitioning."""
    return F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(salt)), 11) / float(1 << 53)


def normal(seed: int, salt: int):
    """Box-Muller on two such numbers."""
    u = F.greatest(uniform(seed, 2 * salt + 1000), F.lit(1e-300))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * uniform(seed, 2 * salt + 1001))


def make_blobs(spark: SparkSession, n: int, n_features: int = 2, centers: int = 3, std: float = 1.0, box=(-10.0, 10.0), seed: int = 0) -> DataFrame:
    """id, x0.., label: Gaussian clusters around centres drawn in a box."""
    c = np.random.default_rng(seed).uniform(*box, size=(centers, n_features))
    rows = spark.range(n).withColumn("label", (F.col("id") % centers).cast("int"))
    at = lambda j: F.element_at(F.array(*[F.lit(float(v)) for v in c[:, j]]), F.col("label") + 1)
    return rows.withColumns({f"x{j}": at(j) + std * normal(seed, j) for j in range(n_features)})


def make_moons(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """id, x0, x1, label: two half circles that reach into each other."""
    half = n // 2
    rows = spark.range(n).withColumn("label", (F.col("id") >= half).cast("int"))
    t = math.pi * F.when(F.col("label") == 0, F.col("id") / max(half - 1, 1)).otherwise((F.col("id") - half) / max(n - half - 1, 1))
    x = F.when(F.col("label") == 0, F.cos(t)).otherwise(1 - F.cos(t))
    y = F.when(F.col("label") == 0, F.sin(t)).otherwise(0.5 - F.sin(t))
    return rows.withColumns({"x0": x + noise * normal(seed, 0), "x1": y + noise * normal(seed, 1)})


def make_circles(spark: SparkSession, n: int, noise: float = 0.0, factor: float = 0.8, seed: int = 0) -> DataFrame:
    """id, x0, x1, label: two rings around one centre."""
    half = n // 2
    rows = spark.range(n).withColumn("label", (F.col("id") >= half).cast("int"))
    t = 2 * math.pi * F.when(F.col("label") == 0, F.col("id") / max(half, 1)).otherwise((F.col("id") - half) / max(n - half, 1))
    r = F.when(F.col("label") == 0, 1.0).otherwise(factor)
    return rows.withColumns({"x0": r * F.cos(t) + noise * normal(seed, 0), "x1": r * F.sin(t) + noise * normal(seed, 1)})


def make_regression(spark: SparkSession, n: int, n_features: int = 10, n_informative: int = 5, noise: float = 0.0, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """(id, x0.., y) and the coefficients: a linear target on the first features."""
    b = [*np.random.default_rng(seed).uniform(1, 100, n_informative).tolist(), *[0.0] * (n_features - n_informative)]
    rows = spark.range(n).withColumns({f"x{j}": normal(seed, j) for j in range(n_features)})
    y = sum((F.col(f"x{j}") * w for j, w in enumerate(b) if w), F.lit(0.0))
    return rows.withColumn("y", y + noise * normal(seed, n_features)), b


def make_spiral(spark: SparkSession, n: int, n_arms: int = 2, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """id, x0, x1, label: arms that wind around the centre."""
    rows = spark.range(n).withColumn("label", (F.col("id") % n_arms).cast("int"))
    r = F.floor(F.col("id") / n_arms) / max(n // n_arms - 1, 1)
    t = 4 * r + 2 * math.pi / n_arms * F.col("label") + noise * normal(seed, 0)
    return rows.withColumns({"x0": r * F.cos(t), "x1": r * F.sin(t)})


def make_classification(spark: SparkSession, n: int, n_features: int = 10, n_informative: int = 4, n_classes: int = 2, sep: float = 2.0, flip: float = 0.0, seed: int = 0) -> DataFrame:
    """id, x0.., label: classes at corners of a cube in the first features, noise in the others, some labels flipped."""
    corners = np.random.default_rng(seed).choice([-1.0, 1.0], size=(n_classes, n_informative))
    for k in range(n_classes):
        # Corners differ at least in the bits of the class's number.
        for j in range(min(n_informative, n_classes.bit_length())):
            corners[k, j] = 1.0 if k >> j & 1 else -1.0
    rows = spark.range(n).withColumn("_k", (F.col("id") % n_classes).cast("int"))
    at = lambda j: F.element_at(F.array(*[F.lit(float(v)) for v in sep * corners[:, j]]), F.col("_k") + 1)
    rows = rows.withColumns({f"x{j}": (at(j) if j < n_informative else F.lit(0.0)) + normal(seed, j) for j in range(n_features)})
    other = (uniform(seed, 998) * n_classes).cast("int")
    return rows.withColumn("label", F.when(uniform(seed, 999) < flip, other).otherwise(F.col("_k"))).drop("_k")
