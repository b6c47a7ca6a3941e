"""Recommendation from ratings: similar items, popularity, and alternating least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize, sized
from .columns import draw
from .patterns import with_own


def item_similarity(ratings: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """(i, j, sim): cosine of the items' ratings less the item's mean, over all users; both directions.

    Only items rated by one user meet, and their products are summed per pair in the tasks. Items without spread have
    no similarity.
    """
    r = ratings.select(F.col(user).alias("u"), F.col(item).alias("i"), F.col(rating).cast("double").alias("r"))
    mean = r.groupBy("i").agg(F.avg("r").alias("m"))
    c = materialize(r.join(mean, "i").select("u", "i", (F.col("r") - F.col("m")).alias("c")), "centred")
    size = c.groupBy("i").agg(F.sqrt(F.sum(F.col("c") ** 2)).alias("s"))
    dots = c.alias("a").join(c.alias("b"), F.col("a.u") == F.col("b.u")).where("a.i <> b.i").groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.c") * F.col("b.c")).alias("d"))
    both = dots.join(size.select("i", F.col("s").alias("si")), "i").join(size.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j")
    return both.where("si > 0 AND sj > 0").select("i", "j", (F.col("d") / (F.col("si") * F.col("sj"))).alias("sim"))


def item_predict(similar: DataFrame, ratings: DataFrame, user: str, item: str, rating: str, k: int = 20) -> DataFrame:
    """(u, i, predicted) for items that a user has not rated: the k most similar rated ones, weighted by similarity.

    Ratings stand with their user before they meet the similarities, so what a user gets of each item is summed in place.
    They are ranked only if an item can meet more than k of one user.
    """
    mine = materialize(ratings.select(F.col(user).alias("u"), F.col(item).alias("j"), F.col(rating).cast("double").alias("r")), "mine")
    similar = materialize(similar, "similar")
    most = similar.groupBy("i").count().agg(F.max("count")).first()[0] or 0
    often = mine.groupBy("u", "j").count().agg(F.max("count")).first()[0] or 0
    met = mine.repartition("u").join(sized(with_own(similar)), "j")
    if most * often > k:
        w = Window.partitionBy("u", "i").orderBy(F.desc(F.abs("sim")), "j")
        # A user's own item has no similarity and ranks last, so it is looked for before the ranks cut.
        met = met.withColumns({"_k": F.row_number().over(w), "own": F.max("own").over(Window.partitionBy("u", "i"))}).where(F.col("_k") <= k)
    told = met.groupBy("u", "i").agg((F.sum(F.col("sim") * F.col("r")) / F.sum(F.abs("sim"))).alias("predicted"), F.max("own").alias("own"))
    return told.where("own is null").select("u", "i", "predicted")


def popularity(ratings: DataFrame, item: str, rating: str, prior: float = 10.0) -> DataFrame:
    """(item, score): the mean rating pulled towards the mean of all by `prior` ratings."""
    g = ratings.agg(F.avg(rating)).first()[0]
    return ratings.groupBy(item).agg(((F.sum(rating) + prior * g) / (F.count("*") + prior)).alias("score"))


def _start(keys: DataFrame, rank: int, seed: int) -> DataFrame:
    values = [(draw(seed, f, F.col("k")) - 0.5).alias(f"v{f}") for f in range(rank)]
    return keys.select("k", F.array(*values).alias("f"))


def _half(ratings: DataFrame, fixed: DataFrame, to: str, by: str, rank: int, reg: float) -> DataFrame:
    """The factors of one side, given the other's: sums of products per key, then a small system solved per key."""
    met = ratings.join(fixed.select(F.col("k").alias(by), "f"), by)
    sums = [F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"p{i}_{j}") for i in range(rank) for j in range(i, rank)]
    sums += [F.sum(F.col("r") * F.col("f")[i]).alias(f"q{i}") for i in range(rank)]
    flat = met.groupBy(F.col(to).alias("k")).agg(F.count("*").alias("n"), *sums)

    def solve(batches):
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            col = {name: b.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(b.schema.names)}
            a = np.empty((n, rank, rank))
            for i in range(rank):
                for j in range(rank):
                    a[:, i, j] = col[f"p{min(i, j)}_{max(i, j)}"]
            a += reg * np.eye(rank) * col["n"][:, None, None]
            y = np.stack([col[f"q{i}"] for i in range(rank)], axis=1)
            f = np.linalg.solve(a, y[:, :, None])[:, :, 0]
            ends = pa.array(np.arange(0, n * rank + 1, rank, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(f.ravel()))], names=["k", "f"])

    kind = ratings.schema[to].dataType.simpleString()
    return flat.mapInArrow(solve, f"k {kind}, f array<double>")


def alternating_least_squares(ratings: DataFrame, user: str, item: str, rating: str, rank: int = 4, rounds: int = 5, reg: float = 0.1, seed: int = 3) -> tuple[DataFrame, DataFrame, float]:
    """(k, f) of users and of items, and the mean: ratings less the mean are products of factors.

    Each half round joins the ratings with one side's factors and aggregates rank x rank sums per key; the ridge grows
    with a key's ratings. Every round's factors are cut by a table in the shared folder.
    """
    mean = float(ratings.agg(F.avg(rating)).first()[0])
    r = materialize(ratings.select(F.col(user).alias("u"), F.col(item).alias("i"), (F.col(rating) - mean).cast("double").alias("r")), "ratings")
    items = materialize(_start(r.select(F.col("i").alias("k")).distinct(), rank, seed), "factors")
    users = items
    for _ in range(rounds):
        users = materialize(_half(r, items, "u", "i", rank, reg), "factors")
        items = materialize(_half(r, users, "i", "u", rank, reg), "factors")
    return users, items, mean


def factor_predict(pairs: DataFrame, users: DataFrame, items: DataFrame, mean: float, user: str, item: str) -> DataFrame:
    """Pairs with `predicted`; a key without factors is predicted by the mean."""
    dot = F.aggregate(F.zip_with("fu", "fi", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    met = pairs.join(users.select(F.col("k").alias(user), F.col("f").alias("fu")), user, "left").join(items.select(F.col("k").alias(item), F.col("f").alias("fi")), item, "left")
    return met.withColumn("predicted", F.coalesce(dot, F.lit(0.0)) + mean).drop("fu", "fi")
