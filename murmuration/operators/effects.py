"""Effects of a treatment and robust or validated linear fits, all from sums: one pass for each set of fits.

Linear fits that differ in their rows only are read off sums by group: a fit without a fold is the fit of all sums less
that fold's, so cross-fitting and cross-validation cost one pass over the table, whatever the number of folds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .columns import draw
from .incremental import moments, sums
from .linear import Linear, gram, ridge

FOLD = "_fold"


def with_folds(df: DataFrame, id_col: str, folds: int, seed: str = "fold") -> DataFrame:
    """Adds the fold of every row, drawn by its id."""
    return df.withColumn(FOLD, F.floor(draw(seed, F.col(id_col)) * folds).cast("int"))


def _by_group(df: DataFrame, columns: list[str], by: str) -> dict[object, dict]:
    """Sums of the rows that have all columns, by group."""
    whole = df
    for c in columns:
        whole = whole.where(F.col(c).isNotNull())
    return {r[by]: {k: v for k, v in r.asDict().items() if k != by} for r in sums(whole, columns, by).collect()}


def _added(parts: list[dict]) -> dict:
    return {k: sum(p[k] for p in parts) for k in parts[0]}


def _fit(total: dict, features: list[str], target: int, used: int, alpha: float = 0.0) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of the first `used` columns for column `target`, from sums."""
    n, mean, cov = moments(total, used if target < used else target + 1)
    x = cov[:used, :used] * n + alpha * np.eye(used)
    b = np.linalg.lstsq(x, cov[:used, target] * n, rcond=1e-12)[0]
    return float(mean[target] - mean[:used] @ b), b


def t_learner(df: DataFrame, treated: str, outcome: str, features: list[str], alpha: float = 0.0) -> Column:
    """The effect of each row: the treated rows' fit less the others'."""
    one, none = (ridge(df.where(F.col(treated) == t), features, outcome, alpha) for t in (1, 0))
    return one.column() - none.column()


def x_learner(df: DataFrame, treated: str, outcome: str, features: list[str], propensity: Column | None = None, alpha: float = 0.0) -> Column:
    """The effect of each row: fits of what each arm's rows differ from the other arm's fit, weighed by the propensity.

    Without a propensity the share of treated rows stands for it.
    """
    rows = df.where(F.col(treated).isin(0, 1))
    one, none = (ridge(rows.where(F.col(treated) == t), features, outcome, alpha) for t in (1, 0))
    gain = F.when(F.col(treated) == 1, F.col(outcome) - none.column()).otherwise(one.column() - F.col(outcome))
    held = rows.withColumn("_gain", gain)
    on, off = (ridge(held.where(F.col(treated) == t), features, "_gain", alpha) for t in (1, 0))
    e = propensity if propensity is not None else F.lit(float(rows.agg(F.avg(treated)).first()[0] or 0.0))
    return e * off.column() + (1 - e) * on.column()


def double_ml(df: DataFrame, treated: str, outcome: str, features: list[str], id_col: str, folds: int = 5, alpha: float = 0.0) -> DataFrame:
    """(effect, se, n): the outcome's residuals on the treatment's, both from fits that have not seen the row's fold.

    Rows that lack a value are left out. The error is robust to uneven variance.
    """
    names = [*features, treated, outcome]
    rows = with_folds(df, id_col, folds)
    for c in names:
        rows = rows.where(F.col(c).isNotNull())
    parts, d = _by_group(rows, names, FOLD), len(features)
    t, y = F.col(treated).cast("double"), F.col(outcome).cast("double")
    for k in parts:
        others = [p for i, p in parts.items() if i != k] or [parts[k]]
        total = _added(others)
        for target, name in ((d, "_t"), (d + 1, "_y")):
            a, b = _fit(total, features, target, d, alpha)
            told = Linear(features, a, b.tolist()).column()
            if name == "_t":
                t = F.when(F.col(FOLD) == k, F.col(treated) - told).otherwise(t)
            else:
                y = F.when(F.col(FOLD) == k, F.col(outcome) - told).otherwise(y)
    left = rows.select(t.alias("_t"), y.alias("_y"))
    s = left.agg(F.sum(F.col("_t") ** 2).alias("tt"), F.sum(F.col("_t") * F.col("_y")).alias("ty"), F.count("*").alias("n")).first()
    effect = s.ty / s.tt if s.tt else None
    if effect is None:
        return df.sparkSession.createDataFrame([(None, None, s.n)], "effect double, se double, n long")
    return left.agg((F.sqrt(F.sum(F.col("_t") ** 2 * (F.col("_y") - effect * F.col("_t")) ** 2)) / s.tt).alias("se"), F.count("*").alias("n")).select(F.lit(float(effect)).alias("effect"), "se", "n")


def ridge_cv(df: DataFrame, features: list[str], target: str, alphas: list[float], id_col: str, folds: int = 5) -> tuple[Linear, DataFrame]:
    """The ridge of the penalty with the least squared error on left-out folds, and (alpha, mse) of all penalties.

    Errors come from the left-out fold's sums, too, so the table is read once. Of equal errors the first penalty wins.
    """
    parts, d = _by_group(with_folds(df, id_col, folds), [*features, target], FOLD), len(features)
    spark, errors = df.sparkSession, []
    if not parts:
        raise ValueError("there are no rows to fit")
    for alpha in alphas:
        wrong = count = 0.0
        for k, held in parts.items():
            a, b = _fit(_added([p for i, p in parts.items() if i != k] or [held]), features, d, d, alpha)
            n, mean, cov = moments(held, d + 1)
            v = np.append(-b, 1.0)
            # Mean squared error of y - a - x b over the fold.
            wrong += n * (v @ cov @ v + (v @ mean - a) ** 2)
            count += n
        errors.append((float(alpha), float(wrong / count)))
    best = min(errors, key=lambda e: e[1])[0]
    a, b = _fit(_added(list(parts.values())), features, d, d, best)
    return Linear(features, a, b.tolist()), spark.createDataFrame(errors, "alpha double, mse double")


def huber(df: DataFrame, features: list[str], target: str, epsilon: float = 1.35, rounds: int = 20, tol: float = 1e-9) -> Linear:
    """A linear fit in which residuals beyond epsilon times their scale count by size, not by square.

    Rounds of weighted least squares; a round's scale is the mean absolute residual of the fit before, over 0.7979, as
    for normal errors, so no order statistics are needed. Rows that lack a value are left out.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("_y"))
    for c in (*features, "_y"):
        rows = rows.where(F.col(c).isNotNull())
    rows = materialize(rows, "huber")
    fit = ridge(rows, features, "_y", 0.0)
    for _ in range(rounds):
        off = F.abs(F.col("_y") - fit.column())
        scale = (rows.agg(F.avg(off)).first()[0] or 0.0) / 0.7978845608028654
        if scale < 1e-300:
            break
        w = F.when(off <= epsilon * scale, 1.0).otherwise(epsilon * scale / off)
        g = gram(rows.withColumn("_w", w), [*features, "_y"], F.col("_w"))
        b = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=1e-12)[0]
        moved = np.abs(b - [fit.intercept, *fit.coefficients]).max()
        fit = Linear(features, float(b[0]), b[1:].tolist())
        if moved < tol:
            break
    return fit
