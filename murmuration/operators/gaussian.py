"""Models of means and covariances: discriminants, covariance estimators, mixtures, and weighted least squares.

Everything is fitted from sums of products, one pass of aggregates over the table (one a round for mixtures); d x d
numbers come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _products(columns: list[str], weight: Column | None = None, prefix: str = "") -> list[Column]:
    w = F.lit(1.0) if weight is None else weight
    out = [F.sum(w).alias(f"{prefix}_w")]
    out += [F.sum(w * F.col(c)).alias(f"{prefix}_s{i}") for i, c in enumerate(columns)]
    out += [F.sum(w * F.col(a) * F.col(b)).alias(f"{prefix}_p{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return out


def _moments(row, d: int, prefix: str = "") -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, mean and population covariance of one row of sums."""
    w = float(row[f"{prefix}_w"] or 0.0)
    mean = np.array([row[f"{prefix}_s{i}"] for i in range(d)], float) / w
    cov = np.array([[row[f"{prefix}_p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float) / w - np.outer(mean, mean)
    return w, mean, cov


def _shifted(df: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Columns less their means, so that products of large numbers do not swallow the covariance."""
    centre = np.array(df.agg(*[F.avg(c) for c in columns]).first(), float)
    return df.withColumns({c: F.col(c) - float(m) for c, m in zip(columns, centre)}), centre


def _quadratic(columns: list[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    """The Mahalanobis form of a row."""
    x = [F.col(c) - float(m) for c, m in zip(columns, mean)]
    return sum((x[i] * x[j] * float(inverse[i, j]) for i in range(len(x)) for j in range(len(x))), F.lit(0.0))


def _best(scores: dict) -> Column:
    """The key with the largest score, the first of equals."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.lit(None)
    for key, score in reversed(list(scores.items())):
        out = F.when(score == top, F.lit(key)).otherwise(out)
    return out


def discriminant(train: DataFrame, label: str, columns: list[str], quadratic: bool = False, reg: float = 1e-6) -> Column:
    """Linear discriminants (one pooled covariance, divisor n - k) or quadratic ones (a covariance per class, n - 1)."""
    df, centre = _shifted(train, columns)
    d = len(columns)
    rows = sorted(((r[label], *_moments(r, d)) for r in df.groupBy(label).agg(*_products(columns)).collect()), key=lambda r: r[0])
    n = sum(r[1] for r in rows)
    pooled = sum(r[1] * r[3] for r in rows) / (n - len(rows)) + reg * np.eye(d)
    scores = {}
    for key, w, mean, cov in rows:
        s = w / max(w - 1, 1) * cov + reg * np.eye(d) if quadratic else pooled
        log_det = np.linalg.slogdet(s)[1] if quadratic else 0.0
        scores[key] = F.lit(math.log(w / n) - 0.5 * float(log_det)) - 0.5 * _quadratic(columns, mean + centre, np.linalg.inv(s))
    return _best(scores)


def covariance_table(df: DataFrame, columns: list[str], kind: str = "empirical", shrinkage: float = 0.1) -> DataFrame:
    """(a, b, cov): empirical, shrunk by a given share, or shrunk by the Ledoit-Wolf or the oracle approximating share.

    Shrinking goes towards the mean variance times the identity. Ledoit-Wolf needs the sum of squared norms, one more
    aggregate of the same pass.
    """
    spark = df.sparkSession
    shifted, _ = _shifted(df, columns)
    d = len(columns)
    square = sum((F.col(c) ** 2 for c in columns), F.lit(0.0))
    row = shifted.agg(*_products(columns), F.sum(square * square).alias("_q")).first()
    n, _, cov = _moments(row, d)
    mu = np.trace(cov) / d
    share = {"empirical": 0.0, "shrunk": shrinkage}.get(kind, 0.0)
    if kind == "ledoit_wolf":
        delta = ((cov - mu * np.eye(d)) ** 2).sum() / d
        beta = (row["_q"] / n - (cov**2).sum()) / (d * n)
        share = min(beta, delta) / delta if delta > 0 else 0.0
    elif kind == "oas":
        alpha = (cov**2).mean()
        top = alpha + mu**2
        bottom = (n + 1) * (alpha - mu**2 / d)
        share = 1.0 if bottom == 0 else min(top / bottom, 1.0)
    cov = (1 - share) * cov + share * mu * np.eye(d)
    rows = [(columns[i], columns[j], float(cov[i, j])) for i in range(d) for j in range(d)]
    return spark.createDataFrame(rows, "a string, b string, cov double")


def weighted_least_squares(df: DataFrame, columns: list[str], target: str, weight: str) -> DataFrame:
    """(term, coefficient): minimises the weighted squares; the normal equations come from one pass."""
    names = [*columns, target]
    row = df.agg(*_products(names, F.col(weight).cast("double"))).first()
    w, mean, cov = _moments(row, len(names))
    slope = np.linalg.solve(cov[:-1, :-1], cov[:-1, -1])
    terms = [("intercept", float(mean[-1] - slope @ mean[:-1])), *zip(columns, map(float, slope))]
    return df.sparkSession.createDataFrame(terms, "term string, coefficient double")


def gaussian_mixture(df: DataFrame, columns: list[str], start: list[list[float]], rounds: int = 10, reg: float = 1e-6) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(weight, mean, covariance) of each component after some rounds of expectation and maximisation from given means.

    A round is one pass: responsibilities are column expressions, and their weighted sums of products are aggregated.
    """
    d = len(columns)
    _, _, spread = _moments(df.agg(*_products(columns)).first(), d)
    parts = [(1.0 / len(start), np.array(m, float), spread + reg * np.eye(d)) for m in start]
    for _ in range(rounds):
        share = responsibilities(columns, parts)
        row = df.agg(*[c for k in range(len(start)) for c in _products(columns, share[k], f"k{k}")]).first()
        found = [_moments(row, d, f"k{k}") for k in range(len(start))]
        total = sum(w for w, _, _ in found)
        parts = [(w / total, mean, cov + reg * np.eye(d)) for w, mean, cov in found]
    return parts


def log_density(columns: list[str], parts: list[tuple[float, np.ndarray, np.ndarray]]) -> list[Column]:
    """Each component's weighted log density."""
    d = len(columns)
    out = []
    for w, mean, cov in parts:
        constant = math.log(w) - 0.5 * (d * math.log(2 * math.pi) + float(np.linalg.slogdet(cov)[1]))
        out.append(F.lit(constant) - 0.5 * _quadratic(columns, mean, np.linalg.inv(cov)))
    return out


def responsibilities(columns: list[str], parts: list[tuple[float, np.ndarray, np.ndarray]]) -> list[Column]:
    """Each component's share in a row."""
    logs = log_density(columns, parts)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    shares = [F.exp(x - top) for x in logs]
    total = sum(shares, F.lit(0.0))
    return [s / total for s in shares]


def yeo_johnson(x: Column, power: float) -> Column:
    """The power transform that takes negative values too."""
    up = F.log1p(x) if abs(power) < 1e-6 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if abs(power - 2) < 1e-6 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_power(df: DataFrame, column: str, low: float = -2.0, high: float = 3.0, steps: int = 21, rounds: int = 4) -> float:
    """The power of greatest likelihood: each round tries evenly spaced powers in one aggregate and narrows in on the best."""
    x = F.col(column).cast("double")
    for _ in range(rounds):
        powers = [low + (high - low) * i / (steps - 1) for i in range(steps)]
        likely = [-0.5 * F.count(x) * F.ln(F.var_pop(yeo_johnson(x, p)) + 1e-12) + (p - 1) * F.sum(F.signum(x) * F.log1p(F.abs(x))) for p in powers]
        row = df.agg(*[c.alias(f"l{i}") for i, c in enumerate(likely)]).first()
        best = max(range(steps), key=lambda i: row[i])
        low, high = powers[max(0, best - 1)], powers[min(steps - 1, best + 1)]
    return powers[best]
