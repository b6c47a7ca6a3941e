"""Linear models from sums of products.

One pass gives n, the means and the products of all columns (a d x d matrix, d columns of features); the solution of
the small system happens on the driver. Iterative fits repeat such a pass with weights. Rows never leave the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import f_tail, t_two_sided


def gram(df: DataFrame, columns: list[Column | str], weight: Column | None = None) -> np.ndarray:
    """Sums of all products of columns (with a leading one), weighted: (d + 1) x (d + 1)."""
    w = F.lit(1.0) if weight is None else weight
    cols = [F.lit(1.0), *[F.col(c).cast("double") if isinstance(c, str) else c for c in columns]]
    d = len(cols)
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    row = df.agg(*[F.sum(w * cols[i] * cols[j]).alias(f"g{i}_{j}") for i, j in cells]).first()
    out = np.zeros((d, d))
    for i, j in cells:
        out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


@dataclass(frozen=True)
class Linear:
    """intercept + sum of coefficients."""

    features: list[str]
    intercept: float
    coefficients: list[float]

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients, strict=True):
            total = total + F.col(c) * b
        return total

    def table(self, spark) -> DataFrame:
        rows = [("intercept", float(self.intercept)), *zip(self.features, map(float, self.coefficients))]
        return spark.createDataFrame(rows, "term string, coefficient double")


def _centred(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """n, means and centred products."""
    n, m = g[0, 0], g[0, 1:] / g[0, 0]
    return n, m, g[1:, 1:] - n * np.outer(m, m)


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> Linear:
    """Least squares with alpha times the squared coefficients; the intercept is free."""
    _, m, s = _centred(gram(df, [*features, target]))
    b = np.linalg.solve(s[:-1, :-1] + alpha * np.eye(len(features)), s[:-1, -1])
    return Linear(features, float(m[-1] - m[:-1] @ b), b.tolist())


def elastic_net(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, l1_ratio: float = 1.0, max_iter: int = 1000, tol: float = 1e-10) -> Linear:
    """Coordinate descent on the products: 1/(2n) squares + alpha (l1 |b| + (1 - l1)/2 b^2)."""
    n, m, s = _centred(gram(df, [*features, target]))
    x, y, b = s[:-1, :-1], s[:-1, -1], np.zeros(len(features))
    for _ in range(max_iter):
        old = b.copy()
        for j in range(len(b)):
            r = y[j] - x[j] @ b + x[j, j] * b[j]
            t = alpha * l1_ratio * n
            b[j] = np.sign(r) * max(abs(r) - t, 0.0) / (x[j, j] + alpha * (1 - l1_ratio) * n)
        if np.max(np.abs(b - old)) < tol:
            break
    return Linear(features, float(m[-1] - m[:-1] @ b), b.tolist())


def ols(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """term, coefficient, se, t, p, with r2, adjusted r2, f and its p on every row."""
    g = gram(df, [*features, target])
    x, y = g[:-1, :-1], g[:-1, -1]
    n, k = g[0, 0], len(features)
    b = np.linalg.solve(x, y)
    rss = g[-1, -1] - b @ y
    tss = g[-1, -1] - g[0, -1] ** 2 / n
    dof = n - k - 1
    se = np.sqrt(np.diag(np.linalg.inv(x)) * rss / dof)
    r2 = 1 - rss / tss
    f = (tss - rss) / k / (rss / dof)
    rows = [
        (name, float(c), float(e), float(c / e), float(t_two_sided(c / e, dof)), float(r2), float(1 - (1 - r2) * (n - 1) / dof), float(f), float(f_tail(f, k, dof)))
        for name, c, e in zip(["intercept", *features], b, se, strict=True)
    ]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, se double, t double, p double, r2 double, adj_r2 double, f double, f_p double")


def weighted_rounds(df: DataFrame, features: list[str], target: str, family: str, l2: float = 0.0, max_iter: int = 30, tol: float = 1e-10) -> Linear:
    """Iteratively reweighted least squares of a generalised linear model: one weighted pass a round.

    Families: binomial (logit), poisson (log), gaussian (identity). `l2` is half the penalty on squared coefficients.
    """
    b = np.zeros(len(features) + 1)
    for _ in range(max_iter):
        eta = Linear(features, float(b[0]), b[1:].tolist()).column()
        if family == "binomial":
            mu = 1 / (1 + F.exp(-eta))
            w = F.greatest(mu * (1 - mu), F.lit(1e-12))
        elif family == "poisson":
            mu = F.exp(F.least(eta, F.lit(30.0)))
            w = F.greatest(mu, F.lit(1e-12))
        else:
            mu, w = eta, F.lit(1.0)
        z = eta + (F.col(target) - mu) / w
        g = gram(df.withColumns({"_w": w, "_z": z}), [*features, "_z"], F.col("_w"))
        x, y = g[:-1, :-1], g[:-1, -1]
        penalty = l2 * np.eye(len(b))
        penalty[0, 0] = 0.0
        new = np.linalg.solve(x + penalty, y)
        done = np.max(np.abs(new - b)) < tol * max(1.0, np.max(np.abs(b)))
        b = new
        if done:
            break
    return Linear(features, float(b[0]), b[1:].tolist())


def logistic(df: DataFrame, features: list[str], target: str, c: float = 1.0) -> Linear:
    """Sum of log losses plus half the squared coefficients over c."""
    return weighted_rounds(df, features, target, "binomial", 1.0 / c)


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, cov): population covariances, straight from one aggregate."""
    g = gram(df, columns)
    n, _, s = _centred(g)
    rows = [(columns[i], columns[j], float(s[i, j] / n)) for i in range(len(columns)) for j in range(len(columns))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, cov double")


def mahalanobis(df: DataFrame, columns: list[str], out: str = "distance2") -> DataFrame:
    """Squared distance of each row to the mean in the metric of the covariance."""
    n, m, s = _centred(gram(df, columns))
    p = np.linalg.pinv(s / n)
    d = [F.col(c) - float(m[i]) for i, c in enumerate(columns)]
    total = F.lit(0.0)
    for i in range(len(columns)):
        for j in range(len(columns)):
            total = total + d[i] * d[j] * float(p[i, j])
    return df.withColumn(out, total)


def pca(df: DataFrame, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """means, components (k x d, largest entry positive) and explained variances (divided by n - 1)."""
    n, m, s = _centred(gram(df, columns))
    values, vectors = np.linalg.eigh(s / (n - 1))
    order = np.argsort(values)[::-1][:k]
    c = vectors[:, order].T
    c *= np.sign(c[np.arange(len(c)), np.argmax(np.abs(c), axis=1)])[:, None]
    return m, c, values[order]


def pca_transform(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    m, c, _ = pca(df, columns, k)
    return df.withColumns({f"pc{i}": sum(((F.col(x) - float(m[j])) * float(c[i, j]) for j, x in enumerate(columns)), F.lit(0.0)) for i in range(len(c))})


def pca_table(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    _, c, v = pca(df, columns, k)
    rows = [(i, x, float(c[i, j]), float(v[i])) for i in range(len(c)) for j, x in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "component int, feature string, loading double, variance double")


def two_stage(df: DataFrame, instrument: list[str], treatment: str, target: str) -> Linear:
    """Two-stage least squares with one treatment: both stages from one pass."""
    g = gram(df, [*instrument, treatment, target])
    k = len(instrument)
    zz, zt, zy = g[: k + 1, : k + 1], g[: k + 1, k + 1], g[: k + 1, k + 2]
    first = np.linalg.solve(zz, zt)
    # The fitted treatment t^ = Z first: its products with one, itself and the target.
    one, tt, ty = zz[0] @ first, first @ zz @ first, first @ zy
    n = g[0, 0]
    b = (ty - one * g[0, -1] / n) / (tt - one * one / n)
    return Linear([treatment], float(g[0, -1] / n - b * one / n), [float(b)])


def discontinuity(df: DataFrame, x: str, y: str, cutoff: float, bandwidth: float | None = None) -> DataFrame:
    """Jump at a cutoff: the difference of the two local lines' values there."""
    h = df.agg(F.stddev_pop(x)).first()[0] if bandwidth is None else bandwidth
    near = df.select((F.col(x) - cutoff).alias("_x"), F.col(y).cast("double").alias("_y")).where(F.abs("_x") <= h)
    side = near.groupBy((F.col("_x") >= 0).alias("right")).agg(F.regr_intercept("_y", "_x").alias("a"), F.count("*").alias("n"))
    return side.agg((F.max(F.when(F.col("right"), F.col("a"))) - F.max(F.when(~F.col("right"), F.col("a")))).alias("effect"), F.sum("n").alias("n"))


def propensity_weighted(df: DataFrame, treated: str, outcome: str, propensity: Column) -> DataFrame:
    """Difference of normalised inverse-propensity means; propensities are clipped to [0.001, 0.999]."""
    e = F.least(F.greatest(propensity, F.lit(1e-3)), F.lit(1 - 1e-3))
    t = F.col(treated)
    one = F.sum(t * F.col(outcome) / e) / F.sum(t / e)
    zero = F.sum((1 - t) * F.col(outcome) / (1 - e)) / F.sum((1 - t) / (1 - e))
    return df.agg((one - zero).alias("ate"))


def doubly_robust(df: DataFrame, treated: str, outcome: str, features: list[str]) -> DataFrame:
    """Augmented inverse-propensity effect with linear outcomes per arm and a logistic propensity."""
    t = F.col(treated)
    m1 = ridge(df.where(t == 1), features, outcome, 1e-9).column()
    m0 = ridge(df.where(t == 0), features, outcome, 1e-9).column()
    e = 1 / (1 + F.exp(-logistic(df, features, treated, 1e6).column()))
    e = F.least(F.greatest(e, F.lit(1e-3)), F.lit(1 - 1e-3))
    y = F.col(outcome)
    return df.agg(F.avg(m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e)).alias("ate"))


def difference_in_differences(df: DataFrame, treated: str, after: str, outcome: str) -> DataFrame:
    mean = lambda a, b: F.avg(F.when((F.col(treated) == a) & (F.col(after) == b), F.col(outcome)))
    return df.agg(((mean(1, 1) - mean(1, 0)) - (mean(0, 1) - mean(0, 0))).alias("effect"))
