"""Rules read off trees, as 0/1 columns in a sparse linear model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .learners import fit_tree, tree_edges
from .linear import Linear, elastic_net


@dataclass(frozen=True)
class Rule:
    """A conjunction of thresholds: (feature, "<" or ">=", threshold)."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        """1 where all conditions hold, 0 where one does not or a feature is null."""
        held = F.lit(True)
        for f, sign, t in self.conditions:
            held = held & (F.col(f) < t if sign == "<" else F.col(f) >= t)
        return F.coalesce(held, F.lit(False)).cast("double")

    def __str__(self) -> str:
        return " and ".join(f"{f} {sign} {t:.6g}" for f, sign, t in self.conditions)


def rules_of(root) -> list[Rule]:
    """The rule of every node below a tree's root; of several thresholds of a feature and side the tightest counts."""
    found: list[Rule] = []

    def walk(node, held: tuple) -> None:
        if held:
            tight: dict[tuple[str, str], float] = {}
            for f, sign, t in held:
                pick = min if sign == "<" else max
                tight[f, sign] = pick(tight.get((f, sign), t), t)
            found.append(Rule(tuple(sorted((f, sign, t) for (f, sign), t in tight.items()))))
        if isinstance(node, tuple):
            f, t, left, right = node
            walk(left, (*held, (f, "<", t)))
            walk(right, (*held, (f, ">=", t)))

    walk(root, ())
    return found


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    linear: Linear
    supports: tuple[float, ...]

    def column(self) -> Column:
        """The model's value for a row."""
        out = F.lit(float(self.linear.intercept))
        for rule, b in zip(self.rules, self.linear.coefficients):
            if b:
                out = out + b * rule.column()
        return out

    def table(self, spark) -> DataFrame:
        """(rule, coefficient, support, importance): rules that count, importance |b| sqrt(s (1 - s)), greatest first."""
        rows = [(str(r), float(b), s, abs(b) * (s * (1 - s)) ** 0.5) for r, b, s in zip(self.rules, self.linear.coefficients, self.supports) if b]
        return spark.createDataFrame(sorted(rows, key=lambda r: (-r[3], r[0])), "rule string, coefficient double, support double, importance double")


def fit_rules(df: DataFrame, features: list[str], target: str, trees: int = 8, max_depth: int = 2, rate: float = 0.3, alpha: float = 0.01, max_bins: int = 32) -> RuleModel:
    """A lasso over the rules of boosted shallow trees; `alpha` is its penalty on rules scaled to unit deviation.

    Trees are fitted to what those before leave, so that each adds rules of its own. The lasso reads sums of products of
    the rules' columns: one aggregate over the table. Rules that hold for every row or none say nothing and go. Rows
    without a target are left out.
    """
    rows = df.where(F.col(target).isNotNull()).select(*features, F.col(target).cast("double").alias("_y"))
    edges = tree_edges(rows, features, max_bins)
    mean = rows.agg(F.avg("_y")).first()[0]
    held, found = rows.withColumn("_left", F.col("_y") - float(mean or 0.0)), {}
    for _ in range(trees):
        tree = fit_tree(held, features, -F.col("_left"), F.lit(1.0), max_depth=max_depth, edges=edges, max_bins=max_bins)
        found.update(dict.fromkeys(rules_of(tree.root)))
        held = materialize(held.withColumn("_left", F.col("_left") - rate * tree.column()), "left")
    rules = list(found)
    if not rules:
        return RuleModel((), Linear([], float(mean or 0.0), []), ())
    shares = rows.agg(*[F.avg(r.column()).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    kept = [(r, s) for r, s in zip(rules, shares) if s and 0 < s < 1]
    scales = [(s * (1 - s)) ** 0.5 for _, s in kept]
    names = [f"r{i}" for i in range(len(kept))]
    scaled = rows.select("_y", *[(r.column() / d).alias(n) for (r, _), d, n in zip(kept, scales, names)])
    fitted = elastic_net(scaled, names, "_y", alpha)
    back = [b / d for b, d in zip(fitted.coefficients, scales)]
    return RuleModel(tuple(r for r, _ in kept), Linear(names, fitted.intercept, back), tuple(s for _, s in kept))
