"""Naive Bayes, centroids, k-means, histogram trees, boosting, anomaly scores, neighbours and sketches."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize, release
from .neighbours import nearest
from .ordering import percentiles, running
from .preprocessing import bin_index


def _argmax(scores: dict, tie_first: bool = True) -> Column:
    """The key of the largest of some columns; ties to the first."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.lit(None)
    for k, c in reversed(list(scores.items())):
        out = F.when(c == best, F.lit(k)).otherwise(out)
    return out


def gaussian_nb(train: DataFrame, label: str, features: list[str], var_smoothing: float = 1e-9):
    """Fit in one aggregate; returns the column of predicted labels."""
    top = max(train.agg(*[F.var_pop(c) for c in features]).first())
    rows = train.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in features], *[F.var_pop(c).alias(f"v_{c}") for c in features]).orderBy(label).collect()
    n = sum(r.n for r in rows)
    scores = {}
    for r in rows:
        s = F.lit(math.log(r.n / n))
        for c in features:
            v = r[f"v_{c}"] + var_smoothing * top
            s = s - 0.5 * math.log(2 * math.pi * v) - (F.col(c) - r[f"m_{c}"]) ** 2 / (2 * v)
        scores[r[label]] = s
    return _argmax(scores)


def count_nb(train: DataFrame, label: str, features: list[str], kind: str = "multinomial", alpha: float = 1.0):
    """Multinomial, complement or Bernoulli naive Bayes over count columns; returns the column of predicted labels."""
    value = (lambda c: (F.col(c) > 0).cast("double")) if kind == "bernoulli" else (lambda c: F.col(c).cast("double"))
    rows = train.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(value(c)).alias(f"s_{c}") for c in features]).orderBy(label).collect()
    n = sum(r.n for r in rows)
    whole = {c: sum(r[f"s_{c}"] for r in rows) for c in features}
    scores = {}
    for r in rows:
        s = F.lit(0.0 if kind == "complement" else math.log(r.n / n))
        if kind == "multinomial":
            total = sum(r[f"s_{c}"] + alpha for c in features)
            for c in features:
                s = s + F.col(c) * math.log((r[f"s_{c}"] + alpha) / total)
        elif kind == "complement":
            total = sum(whole[c] - r[f"s_{c}"] + alpha for c in features)
            for c in features:
                s = s - F.col(c) * math.log((whole[c] - r[f"s_{c}"] + alpha) / total)
        else:
            for c in features:
                p = (r[f"s_{c}"] + alpha) / (r.n + 2 * alpha)
                s = s + F.when(F.col(c) > 0, math.log(p)).otherwise(math.log(1 - p))
        scores[r[label]] = s
    return _argmax(scores)


def nearest_centroid(train: DataFrame, label: str, features: list[str]):
    rows = train.groupBy(label).agg(*[F.avg(c).alias(c) for c in features]).orderBy(label).collect()
    return _argmax({r[label]: -sum(((F.col(c) - r[c]) ** 2 for c in features), F.lit(0.0)) for r in rows})


@dataclass(frozen=True)
class Centres:
    features: list[str]
    points: list[list[float]]

    def distances(self) -> list[Column]:
        return [sum(((F.col(c) - x) ** 2 for c, x in zip(self.features, p, strict=True)), F.lit(0.0)) for p in self.points]

    def predict(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        d = self.distances()
        return df.withColumn(out, _argmax({i: -x for i, x in enumerate(d)})).withColumn(f"{out}_distance", F.least(*d) if len(d) > 1 else d[0])


def k_means(df: DataFrame, features: list[str], start: list[list[float]], max_iter: int = 50, tol: float = 1e-9) -> Centres:
    """Lloyd rounds from given centres: a pass each, k x d sums to the driver. An empty cluster takes the farthest row."""
    data = df.select(*features).persist()
    centres = Centres(features, start)
    for _ in range(max_iter):
        near = centres.predict(data)
        rows = {r.cluster: r for r in near.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in features]).collect()}
        points = [[rows[i][c] for c in features] if i in rows else None for i in range(len(centres.points))]
        if None in points:
            far = near.orderBy(F.desc("cluster_distance"), *features).limit(points.count(None)).collect()
            points = [p if p is not None else [far[points[:i].count(None)][c] for c in features] for i, p in enumerate(points)]
        moved = max(abs(a - b) for p, q in zip(points, centres.points) for a, b in zip(p, q))
        centres = Centres(features, points)
        if moved < tol:
            break
    data.unpersist()
    return centres


def seed_centres(df: DataFrame, features: list[str], k: int) -> list[list[float]]:
    """Farthest-first start: the row of smallest hash, then each time the row farthest from all chosen."""
    first = df.orderBy(F.xxhash64(*features), *features).select(*features).first()
    points = [[float(x) for x in first]]
    while len(points) < k:
        d = Centres(features, points).distances()
        near = F.least(*d) if len(d) > 1 else d[0]
        points.append([float(x) for x in df.select(*features, near.alias("_d")).orderBy(F.desc("_d"), *features).first()[:-1]])
    return points


def seed_vectors(df: DataFrame, vector: str, k: int) -> list[list[float]]:
    """Farthest-first centres of whole vectors: the row of smallest hash, then each time the row farthest from all chosen."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(v.alias("v"))
    points = [list(rows.orderBy(F.xxhash64("v"), "v").first().v)]
    while len(points) < k:
        near = F.array_min(F.array(*[vector_distance(F.col("v"), p) for p in points]))
        points.append(list(rows.select("v", near.alias("d")).orderBy(F.desc("d"), "v").first().v))
    return points


def vector_distance(v: Column, point: list[float]) -> Column:
    """Squared distance of an array column from a point."""
    return F.aggregate(F.zip_with(v, F.array(*map(F.lit, point)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def k_means_vectors(df: DataFrame, vector: str, start: list[list[float]], max_iter: int = 20, tol: float = 1e-9) -> list[list[float]]:
    """Lloyd rounds over whole vectors: one pass a round, whose k means per coordinate come to the driver.

    Sums are taken per cluster and coordinate, so the tasks send k x d numbers each. An empty cluster keeps its centre.
    """
    points, d = start, len(start[0])
    rows = df.select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
    for _ in range(max_iter):
        near = assigned(rows, "v", points)
        found = {r.cluster: [r[f"m{i}"] for i in range(d)] for r in near.groupBy("cluster").agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(d)]).collect()}
        new = [found.get(i, p) for i, p in enumerate(points)]
        moved = max(abs(a - b) for p, q in zip(new, points) for a, b in zip(p, q))
        points = new
        if moved < tol:
            break
    return points


def assigned(df: DataFrame, vector: str, points: list[list[float]]) -> DataFrame:
    """Rows with the nearest centre's `cluster` and its squared distance `distance2`; ties to the first."""
    near = F.array_min(F.array(*[F.struct(vector_distance(F.transform(vector, lambda x: x.cast("double")), p).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(points)]))
    return df.withColumn("_near", near).withColumn("cluster", F.col("_near.i")).withColumn("distance2", F.col("_near.d")).drop("_near")


def grid_dbscan(df: DataFrame, features: list[str], id_col: str, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster): density clusters; noise is null. Neighbours are looked for in grid cells of width eps only.

    Rows at one place are one point with a weight and the smallest of their ids.
    """
    from itertools import product

    from .graph import cut

    cells = {f"_c{i}": F.floor(F.col(c) / eps).cast("long") for i, c in enumerate(features)}
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in features])
    rows = cut(rows.withColumn("at", F.min("id").over(Window.partitionBy(*features))))
    points = cut(rows.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("weight"), *[F.min(c).alias(c) for c in features]).withColumns(cells))
    shifts = F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(t)]) for t in product((-1, 0, 1), repeat=len(features))])
    around = points.withColumn("_t", F.explode(shifts)).select(
        F.col("id").alias("other"), F.col("weight").alias("o_weight"), *[F.col(c).alias(f"o_{c}") for c in features], *[(F.col(f"_c{i}") + F.col(f"_t.s{i}")).alias(f"_c{i}") for i in range(len(features))]
    )
    d2 = sum(((F.col(c) - F.col(f"o_{c}")) ** 2 for c in features), F.lit(0.0))
    pairs = points.join(around, list(cells)).where(d2 <= eps * eps).select("id", "other", "o_weight")
    core = cut(pairs.groupBy("id").agg(F.sum("o_weight").alias("n")).where(F.col("n") >= min_samples).select("id"))
    edges = cut(pairs.join(core, "id", "left_semi").select("id", "other"))
    labels = cut(core.withColumn("cluster", F.col("id")))
    between = edges.join(core.withColumnRenamed("id", "other"), "other", "left_semi")
    while True:
        low = between.join(labels.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id").agg(F.min("cluster").alias("low"))
        new = cut(labels.join(low, "id", "left").select("id", F.least("cluster", "low").alias("cluster"), F.col("cluster").alias("old")))
        # Jump to the label of the label, which halves the way.
        hop = new.select(F.col("id").alias("cluster"), F.col("cluster").alias("up"))
        jumped = cut(new.join(hop, "cluster", "left").select("id", F.least("cluster", "up").alias("cluster"), "old"))
        labels = jumped.select("id", "cluster")
        if not jumped.where("cluster <> old").limit(1).count():
            break
    border = edges.join(labels, "id").select(F.col("other").alias("id"), "cluster").groupBy("id").agg(F.min("cluster").alias("b"))
    found = points.select("id").join(labels, "id", "left").join(border, "id", "left").select(F.col("id").alias("at"), F.coalesce("cluster", "b").alias("cluster"))
    return rows.select("id", "at").join(found, "at").select("id", "cluster")


# Trees on binned features. A level is one aggregate over (node, feature, bin).


@dataclass
class Tree:
    """Nested splits: (feature, threshold, left, right), or a value."""

    features: list[str]
    root: object = field(default=0.0)

    def column(self) -> Column:
        def build(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            f, t, left, right = node
            return F.when(F.col(f) < t, build(left)).otherwise(build(right))

        return build(self.root)


def tree_edges(df: DataFrame, features: list[str], max_bins: int = 32) -> dict[str, list[float]]:
    """Bin edges of all features from one pass; they may be approximate percentiles, splits are exact on the bins."""
    points = F.array(*[F.lit(i / max_bins) for i in range(max_bins + 1)])
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), points, F.lit(10_000)).alias(f) for f in features]).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def fit_tree(df: DataFrame, features: list[str], gradient: Column, hessian: Column, max_depth: int = 3, max_bins: int = 32, l2: float = 1.0, min_hessian: float = 1.0, edges: dict[str, list[float]] | None = None) -> Tree:
    """A regression tree of -sum(g) / (sum(h) + l2) leaves, grown level by level on histograms.

    One scan of the table sums rows that fall into the same bins; the levels work on these sums. At each level a row adds
    its g and h to the bin of every feature at its node; node x feature x bin sums come to the driver
    (2**depth * d * bins numbers).
    """
    edges = edges or tree_edges(df, features, max_bins)
    binned = df.select(gradient.cast("double").alias("_g"), hessian.cast("double").alias("_h"), *[bin_index(F.col(f).cast("double"), edges[f]).alias(f"_b_{f}") for f in features])
    # Rows alike in all bins weigh as one: the levels see at most as many rows as there are combinations of bins.
    binned = materialize(binned.groupBy(*[f"_b_{f}" for f in features]).agg(F.sum("_g").alias("_g"), F.sum("_h").alias("_h")).withColumn("node", F.lit(1)), "tree")
    data = binned
    splits: dict[int, tuple[str, int]] = {}
    values: dict[int, float] = {}
    frontier = {1}
    for depth in range(max_depth + 1):
        cells = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_b_{f}").alias("b")) for f in features])
        rows = data.where(F.col("node").isin(sorted(frontier))).select("node", "_g", "_h", F.explode(cells).alias("c")).groupBy("node", "c.f", "c.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()
        table: dict = {}
        for r in rows:
            table.setdefault(r.node, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
        nxt = set()
        for k in sorted(frontier):
            hist = table.get(k)
            if not hist:
                values[k] = 0.0
                continue
            g, h = map(sum, zip(*hist[features[0]].values()))
            values[k] = -g / (h + l2)
            best, gain = None, 1e-12
            if depth < max_depth:
                for f in features:
                    gl = hl = 0.0
                    for b in sorted(x for x in hist[f] if x is not None)[:-1]:
                        gl, hl = gl + hist[f][b][0], hl + hist[f][b][1]
                        if hl < min_hessian or h - hl < min_hessian:
                            continue
                        won = gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
                        if won > gain:
                            best, gain = (f, b), won
            if best:
                splits[k] = best
                nxt |= {2 * k, 2 * k + 1}
        frontier = nxt
        if not frontier:
            break
        # Each row moves to its child; only the splits of this level are in the expression.
        step = F.col("node")
        for k in {n // 2 for n in frontier}:
            f, b = splits[k]
            step = F.when(F.col("node") == k, 2 * k + (F.col(f"_b_{f}") > b).cast("int")).otherwise(step)
        data = data.withColumn("node", step)
    release(df.sparkSession, binned)

    def build(k: int):
        if k not in splits:
            return float(values.get(k, 0.0))
        f, b = splits[k]
        return (f, float(edges[f][b + 1]), build(2 * k), build(2 * k + 1))

    return Tree(features, build(1))


def fit_boosting(df: DataFrame, features: list[str], target: str, rounds: int = 10, rate: float = 0.1, loss: str = "squared", **options) -> Column:
    """Histogram gradient boosting: the score column (a probability for `logistic`)."""
    mean = df.agg(F.avg(target)).first()[0]
    options.setdefault("edges", tree_edges(df, features, options.get("max_bins", 32)))
    start, trees = float(math.log(mean / (1 - mean)) if loss == "logistic" else mean), []
    score = F.lit(start)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-score)) if loss == "logistic" else score
        tree = fit_tree(df, features, p - F.col(target), p * (1 - p) if loss == "logistic" else F.lit(1.0), **options)
        # The score so far is a column that is written each round, so no round computes the earlier trees again.
        held = materialize(df.withColumn("_score", score + rate * tree.column()) if "_score" not in df.columns else df.withColumn("_score", F.col("_score") + rate * tree.column()), "scores")
        trees.append(tree)
        df, score = held, F.col("_score")
    score = sum((rate * t.column() for t in trees), F.lit(start))
    return 1 / (1 + F.exp(-score)) if loss == "logistic" else score


def random_forest(df: DataFrame, features: list[str], target: str, id_col: str, trees: int = 5, seed: int = 0, **options) -> Column:
    """The mean of trees grown on Poisson bootstraps of the rows; features are thinned per tree by hash."""
    edges = tree_edges(df, features, options.get("max_bins", 32))
    found = []
    for t in range(trees):
        u = (F.pmod(F.xxhash64(F.lit(seed + t), id_col), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        times = sum(((u > c).cast("double") for c in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634)), F.lit(0.0))
        chosen = [f for i, f in enumerate(features) if len(features) < 3 or (i + t + seed) % 3]
        found.append(fit_tree(df, chosen, -F.col(target) * times, times, l2=0.0, edges=edges, **options).column())
    return sum(found, F.lit(0.0)) / trees


def ada_boost(df: DataFrame, features: list[str], target: str, rounds: int = 5, **options) -> tuple[list[tuple[float, Tree]], Column]:
    """Weighted shallow trees for labels 0/1: each round weighs up what the last one got wrong. Gives trees and the vote."""
    edges = tree_edges(df, features, options.get("max_bins", 32))
    held = materialize(df.withColumn("_w", F.lit(1.0 / max(df.count(), 1))), "weights")
    found = []
    for _ in range(rounds):
        tree = fit_tree(held, features, -(2 * F.col(target) - 1) * F.col("_w"), F.col("_w"), l2=0.0, min_hessian=0.0, edges=edges, **{"max_depth": 1, **options})
        guess = (tree.column() > 0).cast("int")
        wrong = held.agg(F.sum(F.when(guess != F.col(target), F.col("_w")).otherwise(0.0)) / F.sum("_w")).first()[0]
        wrong = min(max(wrong, 1e-10), 1 - 1e-10)
        say = 0.5 * math.log((1 - wrong) / wrong)
        found.append((say, tree))
        if wrong >= 0.5:
            break
        held = materialize(held.withColumn("_w", F.col("_w") * F.exp(F.when(guess != F.col(target), say).otherwise(-say))), "weights")
    vote = sum((say * F.when(tree.column() > 0, 1.0).otherwise(-1.0) for say, tree in found), F.lit(0.0))
    return found, (vote > 0).cast("int")


# Anomaly scores.


def hbos(df: DataFrame, features: list[str], n_bins: int = 10, out: str = "score") -> DataFrame:
    """Sum over features of the log of 1 / density in equal-width bins."""
    stats = df.agg(F.count("*").alias("n"), *[F.min(c).alias(f"l_{c}") for c in features], *[F.max(c).alias(f"h_{c}") for c in features]).first()
    width = {c: ((stats[f"h_{c}"] - stats[f"l_{c}"]) / n_bins) or 1.0 for c in features}
    code = {c: F.least(F.floor((F.col(c) - stats[f"l_{c}"]) / width[c]), F.lit(n_bins - 1)).cast("int") for c in features}
    cells = F.array(*[F.struct(F.lit(c).alias("f"), code[c].alias("b")) for c in features])
    counts = {(r.f, r.b): r.n for r in df.select(F.explode(cells).alias("e")).groupBy("e.f", "e.b").agg(F.count("*").alias("n")).collect()}
    total = F.lit(0.0)
    for c in features:
        density = F.element_at(F.array(*[F.lit(counts.get((c, b), 0) / (stats.n * width[c])) for b in range(n_bins)]), code[c] + 1)
        total = total + F.ln(1 / (density + 1e-10))
    return df.withColumn(out, total)


def tail_scores(df: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """(id, ecod, copod): how far in the tails a row lies, from the empirical distribution of each feature.

    Distinct values are counted and ranked per feature, so repeated values cost one row.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in features])
    long = df.select(F.col(id_col).alias("id"), F.explode(cells).alias("e")).select("id", "e.f", "e.v")
    counts = running(long.groupBy("f", "v").agg(F.count("*").alias("n")), ["v"], {"upto": "n"}, ["f"], totals=True)
    every = F.col("upto_all")
    ranks = counts.select("f", "v", (F.col("upto") / every).alias("left"), ((every - F.col("upto") + F.col("n")) / every).alias("right"))
    low = lambda c: -F.ln(F.greatest(F.col(c), F.lit(1e-10)))
    j = long.join(ranks, ["f", "v"]).groupBy("id").agg(F.sum(F.greatest(low("left"), low("right"))).alias("ecod"), F.sum(low("left")).alias("l"), F.sum(low("right")).alias("r"))
    return j.select("id", "ecod", F.greatest("l", "r").alias("copod"))


def outliers_iqr(df: DataFrame, score: str, k: float = 1.5) -> DataFrame:
    q1, q3 = percentiles(df, {score: F.col(score)}, [0.25, 0.75])[score]
    return df.withColumn("is_outlier", F.col(score) > q3 + k * (q3 - q1))


def outliers_mad(df: DataFrame, score: str, k: float = 3.0) -> DataFrame:
    """Robust z-scores above k; the upper tail only."""
    m = percentiles(df, {score: F.col(score)}, [0.5])[score][0]
    mad = percentiles(df, {score: F.abs(F.col(score) - m)}, [0.5])[score][0]
    return df.withColumn("is_outlier", (F.col(score) - m) / (1.4826 * (mad + 1e-12)) > k)


# Neighbours and sketches.


def knn(queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int = 5) -> DataFrame:
    """(q, id, distance, rank): exact nearest neighbours of a stated query set against all rows; see `neighbours`."""
    return nearest(queries, base, id_col, vector, k)


def sign_buckets(df: DataFrame, id_col: str, vector: str, dim: int, n_tables: int = 8, n_bits: int = 8, seed: int = 7) -> DataFrame:
    """(id, table, code): random-hyperplane codes of vectors, a matrix product per Arrow batch."""
    planes = np.random.default_rng(seed).normal(size=(n_tables * n_bits, dim))
    powers = 1 << np.arange(n_bits)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            bits = (x @ planes.T >= 0).reshape(b.num_rows, n_tables, n_bits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), n_tables)),
                    pa.array(np.tile(np.arange(n_tables, dtype=np.int32), b.num_rows)),
                    pa.array((bits @ powers).astype(np.int32).ravel()),
                ],
                names=["id", "table", "code"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, table int, code int")


def bloom_bits(count: int, per_item: int = 13) -> int:
    """Bits for a number of items, in whole words: 13 an item and 4 hashes take one stranger in 200 for a member."""
    return max(1 << 17, -(-count * per_item // 32) * 32)


def bloom_filter(items: DataFrame, column: str, bits: int, hashes: int) -> list[int]:
    """A Bloom filter of a fixed number of bits, as words of 32: set bits are merged by bitwise or, word by word."""
    at = F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(bits)) for i in range(hashes)])
    each = items.select(F.explode(at).alias("b")).select(F.shiftright("b", 5).alias("w"), F.expr("shiftleft(1L, cast(b % 32 as int))").alias("v"))
    words = [0] * ((bits + 31) // 32)
    for r in each.groupBy("w").agg(F.bit_or("v").alias("v")).toLocalIterator():
        words[r.w] = r.v
    return words


def bloom_contains(df: DataFrame, column: str, words: list[int], bits: int, hashes: int, out: str = "maybe") -> DataFrame:
    """Whether a value may be among the items; never false for one that is."""
    # One row with all words, of a size that the parameter fixes, travels to every task.
    held = df.sparkSession.createDataFrame([(words,)], "_words array<bigint>")
    df, table, hit = df.crossJoin(F.broadcast(held)), F.col("_words"), F.lit(True)
    for i in range(hashes):
        p = F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(bits))
        word = F.element_at(table, (F.shiftright(p, 5) + 1).cast("int"))
        hit = hit & (F.call_function("shiftright", word, (p % 32).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return df.withColumn(out, hit).drop("_words")


def quantiles_by_sketch(df: DataFrame, column: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """q: the exact discrete quantiles. A sketch brackets each between two values; a second pass counts what lies between.

    Counts are made by value within the brackets only, so what is shuffled is some 6 / accuracy of the rows at most, plus
    the copies of the values at the brackets, which are counted in the tasks first.
    """
    known = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    slack = 3.0 / accuracy
    ends = [[max(0.0, p - slack), min(1.0, p + slack)] for p in shares]
    found = known.agg(F.percentile_approx("v", F.array(*[F.lit(x) for e in ends for x in e]), accuracy).alias("e"), F.count("*").alias("n")).first()
    if not found.n:
        return df.sparkSession.createDataFrame([([None] * len(shares),)], "q array<double>")
    low, high = found.e[::2], found.e[1::2]
    below = known.agg(*[F.sum((F.col("v") < low[i]).cast("long")).alias(f"b{i}") for i in range(len(shares))]).first()
    inside = reduce(lambda a, b: a | b, [F.col("v").between(a, b) for a, b in zip(low, high)])
    counts = materialize(known.where(inside).groupBy("v").agg(F.count("*").alias("n")), "bracketed")
    out = []
    for i, p in enumerate(shares):
        upto = running(counts.where(F.col("v").between(low[i], high[i])), ["v"], {"upto": "n"})
        place = max(1, found.n - math.floor(found.n - p * found.n))
        out.append(upto.where(F.col("upto") + below[i] >= place).agg(F.min("v").alias(f"q{i}")))
    every = reduce(lambda a, b: a.crossJoin(b), out)
    return every.select(F.array(*[F.col(f"q{i}") for i in range(len(shares))]).alias("q"))


def reservoir(df: DataFrame, k: int, id_col: str, seed: int = 0) -> DataFrame:
    """k rows in random order: each partition keeps its k smallest digests, then the k smallest of those."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(k)


# Conformal intervals.


def conformal_quantile(df: DataFrame, score: str, coverage: float, by: list[str] | None = None) -> DataFrame:
    """The order statistic of rank min(ceil((n + 1) * coverage), n), overall or per group."""
    by = by or []
    counts = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("_c"))
    t = running(counts, ["_s"], {"_u": "_c"}, by, totals=True)
    rank = F.least(F.ceil((F.col("_u_all") + 1) * coverage), F.col("_u_all"))
    picked = t.where(F.col("_u") >= rank)
    return (picked.groupBy(*by) if by else picked.groupBy()).agg(F.min("_s").alias("q"))
