"""Models kept as sums that grow: a batch is summed, sums are added up, and models are read off the sums at any time.

The sums are one small table, so a stream adds to them batch by batch (`grow` in foreachBatch) and a table in one pass;
either way the model is the one that the whole data gives.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize


def sums(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(by, n, s0.., p0_0..): counts, sums and sums of products, per group or of all rows."""
    x = [F.col(c).cast("double") for c in columns]
    aggs = [F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]]
    aggs += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return df.groupBy(*([by] if by else [])).agg(*aggs)


def grow(state: DataFrame | None, batch: DataFrame, by: str | None = None) -> DataFrame:
    """The sums of both; written, so that the chain of batches stays short."""
    if state is None:
        return materialize(batch, "sums")
    names = [c for c in batch.columns if c != by]
    both = state.unionByName(batch).groupBy(*([by] if by else [])).agg(*[F.sum(c).alias(c) for c in names])
    return materialize(both, "sums")


def moments(row, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and population covariance of a row of sums."""
    n = float(row["n"])
    mean = np.array([row[f"s{i}"] for i in range(d)]) / n
    cov = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / n - np.outer(mean, mean)
    return n, mean, cov


def scaler_table(state: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, sd) as a scaler would have fitted them."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col(f"s{i}") / F.col("n")).alias("mean"), F.sqrt(F.col(f"p{i}_{i}") / F.col("n") - F.pow(F.col(f"s{i}") / F.col("n"), 2)).alias("sd"))
        for i, c in enumerate(columns)
    ])
    return state.select(F.explode(cells).alias("c")).select("c.*")


def components(state: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(component, feature, loading, variance): principal components of all batches; the largest loading is positive."""
    n, _, cov = moments(state.first(), len(columns))
    values, vectors = np.linalg.eigh(cov * n / max(n - 1, 1))
    rows = []
    for at, i in enumerate(np.argsort(-values)[:k]):
        v = vectors[:, i]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        rows += [(at, c, float(x), float(values[i])) for c, x in zip(columns, v)]
    return state.sparkSession.createDataFrame(rows, "component long, feature string, loading double, variance double")


def nearest_means(state: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, mean of each column): the centroids of classes over all batches."""
    return state.select(by, *[(F.col(f"s{i}") / F.col("n")).alias(c) for i, c in enumerate(columns)])


def naive_bayes(state: DataFrame, by: str, columns: list[str], smooth: float = 1e-9) -> Column:
    """The likeliest class of a row, from the sums of each class: independent normal columns, least class of equal ones.

    Variances are raised by `smooth` times the greatest variance of a column over all classes.
    """
    rows = state.where(F.col(by).isNotNull()).orderBy(by).collect()
    total = sum(r["n"] for r in rows)
    d = len(columns)
    whole = {k: sum(r[k] for r in rows) for r in rows[:1] for k in r.asDict() if k != by}
    floor = smooth * max(np.diag(moments(whole, d)[2])) if rows else 0.0
    scores = []
    for r in rows:
        n, mean, cov = moments(r, d)
        score = F.lit(float(np.log(n / total)))
        for c, m, v in zip(columns, mean, np.diag(cov) + floor):
            score = score - (F.col(c) - float(m)) ** 2 / (2 * float(v)) - 0.5 * float(np.log(2 * np.pi * v))
        scores.append(F.struct((-score).alias("s"), F.lit(r[by]).alias("c")))
    return F.array_min(F.array(*scores))["c"] if scores else F.lit(None).cast(state.schema[by].dataType)


def grow_stream(stream: DataFrame, columns: list[str], by: str | None, checkpoint: str, held: dict):
    """Adds every micro-batch of a stream to the sums in held["state"]; the running query.

    A micro-batch that is given again after a failure is told by its number and not added twice.
    """

    def take(batch: DataFrame, number: int) -> None:
        if number > held.get("batch", -1):
            held["state"] = grow(held.get("state"), sums(batch, columns, by), by)
            held["batch"] = number

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mini_batch_k_means(batches: list[DataFrame], columns: list[str], start: list[list[float]]) -> list[list[float]]:
    """Centres moved by each batch towards the mean of its rows, by the share of all rows a centre has seen."""
    points, seen = [list(p) for p in start], [0] * len(start)
    for batch in batches:
        near = F.array_min(F.array(*[F.struct(sum(((F.col(c) - x) ** 2 for c, x in zip(columns, p)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(points)]))
        for r in batch.withColumn("_c", near["i"]).groupBy("_c").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns]).collect():
            seen[r._c] += r.n
            points[r._c] = [p + (r[c] - r.n * p) / seen[r._c] for p, c in zip(points[r._c], columns)]
    return points
