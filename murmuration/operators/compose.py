"""Steps put together: pipelines, steps per column set, side by side unions, cross-validation and grid search.

A step is a function fit(df, columns) whose result has `transform(df)`. Fitting is a pass of aggregates, transforming a
projection, so a composition of any size stays one scan without a shuffle. A model is a function fit(train) whose result
is the column of its predictions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame, list[str]], Any]
Model = Callable[[DataFrame], Column]


@dataclass(frozen=True)
class Chain:
    """Fitted steps in order."""

    steps: list

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df


def pipeline(df: DataFrame, steps: list[tuple[Step, list[str]]]) -> Chain:
    """Each step fitted on what the ones before it make of the table."""
    fitted = []
    for fit, columns in steps:
        step = fit(df, columns)
        df = step.transform(df)
        fitted.append(step)
    return Chain(fitted)


@dataclass(frozen=True)
class Beside:
    """Fitted steps, each on its own copies of its columns, named `name__column`."""

    parts: list[tuple[str, list[str], Any]]
    keep: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({f"{name}__{c}": F.col(c) for name, columns, _ in self.parts for c in columns})
        for _, _, step in self.parts:
            out = step.transform(out)
        return out.select(*self.keep, *[c for c in out.columns if c not in df.columns])


def side_by_side(df: DataFrame, parts: list[tuple[str, Step, list[str]]], keep: list[str]) -> Beside:
    """A step for each column set, or several for the same columns; results stand beside the kept columns."""
    copies = df.withColumns({f"{name}__{c}": F.col(c) for name, _, columns in parts for c in columns})
    return Beside([(name, columns, fit(copies, [f"{name}__{c}" for c in columns])) for name, fit, columns in parts], keep)


@dataclass(frozen=True)
class Chosen:
    """Keeps some columns; the rest never reaches the scan."""

    columns: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns)


def from_scores(scores: DataFrame, threshold: float, keep: list[str], score: str = "f") -> Chosen:
    """The features whose score is at least a threshold: a transform by mask."""
    found = scores.where(F.col(score) >= threshold).orderBy("feature").select("feature").collect()
    return Chosen([*keep, *[r.feature for r in found]])


# Scores are aggregates of truth and prediction: any function of the two columns that gives an aggregate column.

SCORES: dict[str, Callable[[Column, Column], Column]] = {
    "r2": lambda y, p: 1 - F.sum((y - p) ** 2) / (F.var_pop(y) * F.count(y)),
    "mae": lambda y, p: F.avg(F.abs(y - p)),
    "rmse": lambda y, p: F.sqrt(F.avg((y - p) ** 2)),
    "accuracy": lambda y, p: F.avg((y == p).cast("double")),
}


def cross_val_predict(df: DataFrame, fold: str, fit: Model, out: str = "predicted") -> DataFrame:
    """Every row predicted by the model that was fitted without its fold; one projection over the whole table."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    predicted = F.lit(None)
    for k in folds:
        predicted = F.when(F.col(fold) == k, fit(df.where(F.col(fold) != k))).otherwise(predicted)
    return df.withColumn(out, predicted)


def cross_val_score(df: DataFrame, fold: str, fit: Model, y: str, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(fold, score): one aggregate over all folds."""
    return cross_val_predict(df, fold, fit, "_p").groupBy(fold).agg(score(F.col(y), F.col("_p")).alias("score"))


def grid_search(df: DataFrame, fold: str, make: Callable[..., Model], grid: dict[str, list], y: str, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(candidate, parameters, mean, sd): all combinations, each scored on all folds; the rows of one scan."""
    names = sorted(grid)
    candidates = [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]
    every = df
    for i, values in enumerate(candidates):
        every = cross_val_predict(every, fold, make(**values), f"_p{i}")
    per = every.groupBy(fold).agg(*[score(F.col(y), F.col(f"_p{i}")).alias(f"s{i}") for i in range(len(candidates))])
    cells = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(str(c)).alias("parameters"), F.col(f"s{i}").alias("s")) for i, c in enumerate(candidates)])
    flat = per.select(F.explode(cells).alias("e")).select("e.*")
    return flat.groupBy("candidate", "parameters").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"))


def learning_curve(df: DataFrame, fold: str, order: str, n: int, shares: list[float], fit: Model, y: str, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(share, mean): fold scores of models fitted on the first rows of an order (0 to n - 1) only."""
    parts = []
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    for share in shares:
        predicted = F.lit(None)
        for k in folds:
            predicted = F.when(F.col(fold) == k, fit(df.where((F.col(fold) != k) & (F.col(order) < share * n)))).otherwise(predicted)
        per = df.withColumn("_p", predicted).groupBy(fold).agg(score(F.col(y), F.col("_p")).alias("s"))
        parts.append(per.agg(F.lit(float(share)).alias("share"), F.avg("s").alias("mean")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def voting(models: list[Column], weights: list[float] | None = None) -> Column:
    """The weighted mean of several models' predictions."""
    weights = weights or [1.0] * len(models)
    return sum((m * w for m, w in zip(models, weights, strict=True)), F.lit(0.0)) / sum(weights)


def stacking(df: DataFrame, fold: str, fits: list[Model], final: Callable[[DataFrame, list[str]], Callable[[dict[str, Column]], Column]]) -> Column:
    """A last model over the out-of-fold predictions of several; predictions then come from models of all rows.

    `final` fits on named columns and gives a function from columns of these names to the prediction.
    """
    held = df
    names = [f"_m{i}" for i in range(len(fits))]
    for name, fit in zip(names, fits):
        held = cross_val_predict(held, fold, fit, name)
    return final(held, names)(dict(zip(names, [fit(df) for fit in fits])))
