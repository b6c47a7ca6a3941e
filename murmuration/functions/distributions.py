"""Tail probabilities as column expressions where a closed form exists, and by vectorised series otherwise.

Statistics tables have one row per feature or lag, so the Arrow-batched functions here see few rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_sf(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0 or a <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * math.exp(a * math.log(x) - x - math.lgamma(a)))
    # Lentz's continued fraction.
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return h * math.exp(a * math.log(x) - x - math.lgamma(a))


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """The inverse by bisection on the distribution function, to machine precision."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_tail(x: float, k: float) -> float:
    return gamma_sf(k / 2, x / 2)


def _vector(f):
    """A scalar function over the rows of an Arrow batch; missing arguments give a missing result."""

    def run(*args: pd.Series) -> pd.Series:
        table = np.stack([a.to_numpy(np.float64) for a in args], axis=1)
        return pd.Series([f(*row) if np.isfinite(row).all() else None for row in table], dtype="float64")

    return run


def chi2_sf(x: Column, k: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, k: pd.Series) -> pd.Series:
        return _vector(chi2_tail)(x, k)

    return run(x.cast("double"), k.cast("double"))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def run(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return _vector(f_tail)(f, d1, d2)

    return run(f.cast("double"), d1.cast("double"), d2.cast("double"))


def normal_cdf_column(x: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return _vector(normal_cdf)(x)

    return run(x.cast("double"))


def digamma_array(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma at positive values: shifted up to 10, then its asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while True:
        small = x < 10
        if not small.any():
            break
        out = np.where(small, out - 1 / np.where(small, x, 1.0), out)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f * (1 / 132)))))


def log_gamma_array(x: np.ndarray) -> np.ndarray:
    """Log gamma at positive values: shifted up to 16, then Stirling's series."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    while True:
        small = x < 16
        if not small.any():
            break
        shift = np.where(small, shift + np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / x - shift
