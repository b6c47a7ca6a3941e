"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(columns) -> Column:
    """The sum of a list of columns."""
    return reduce(lambda a, b: a + b, columns)


def clean(column) -> Column:
    """A double in which NaN is null, so that both count as missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.isnan(c.cast("double")), None).otherwise(c.cast("double"))


def or_one(c: Column) -> Column:
    """A scale: zero counts as one."""
    return F.when(c == 0, 1.0).otherwise(c)


def softmax(a: Column) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def log_softmax(a: Column) -> Column:
    m = F.array_max(a)
    s = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return F.transform(a, lambda x: x - m - F.ln(s))


def sigmoid(x: Column) -> Column:
    """The logistic function, computed from the side on which exp stays small."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def soft_threshold(x: Column, t: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def gelu(x: Column) -> Column:
    """The tanh form of the Gaussian error linear unit."""
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


def kl_divergence_normal(mu: Column, logvar: Column) -> Column:
    """KL of N(mu, exp(logvar)) from the standard normal, summed over two array columns."""
    parts = F.zip_with(mu, logvar, lambda m, v: -0.5 * (1 + v - m * m - F.exp(v)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def crps_ensemble(forecasts: Column, y: Column) -> Column:
    """Continuous ranked probability score of an array of forecasts for one value."""
    n = F.size(forecasts)
    first = F.aggregate(forecasts, F.lit(0.0), lambda s, f: s + F.abs(f - y)) / n
    pairs = F.aggregate(forecasts, F.lit(0.0), lambda s, f: s + F.aggregate(forecasts, F.lit(0.0), lambda t, g: t + F.abs(f - g)))
    return first - pairs / (2 * n * n)


def uplift_score(treated: Column, control: Column) -> Column:
    """The difference that the treatment is predicted to make."""
    return treated - control


def energy_score(logits: Column, temperature: float = 1.0) -> Column:
    """Out-of-distribution score of an array of logits: -T * logsumexp(logits / T)."""
    m = F.array_max(logits) / temperature
    s = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x / temperature - m))
    return -temperature * (m + F.ln(s))


def check_table(df: DataFrame, columns: list[str], allow_nan: bool = False) -> DataFrame:
    """The columns as doubles; raises if one is missing, or if any value is infinite (or, unless allowed, missing)."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {absent}")
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    bad = total([
        (F.when(F.abs(F.col(c)) == float("inf"), 1).otherwise(0) + (0 if allow_nan else F.when(F.isnan(c) | F.col(c).isNull(), 1).otherwise(0)))
        for c in columns
    ])
    if typed.agg(F.sum(bad)).first()[0]:
        raise ValueError("the columns hold infinite or missing values")
    return typed


def draw(*parts) -> Column:
    """An even draw in [0, 1) that depends on the parts alone: the first 52 bits of an MD5 digest of their texts.

    Any engine with MD5 draws the same. Nulls are left out of the text.
    """
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)
