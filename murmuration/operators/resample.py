"""New rows for rare classes, and missing values taken from the nearest rows or from a regression on the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .columns import draw
from .gaussian import weighted_least_squares
from .learners import knn


def smote(df: DataFrame, id_col: str, label: str, rare, columns: list[str], k: int = 5, copies: int = 1, seed: int = 0) -> DataFrame:
    """(id, copy, neighbour, columns...): new rows of a class, each between a row and one of its k nearest of that class.

    The neighbour and the share of the way come from hashes of the row's id, so a rerun gives the same rows.
    """
    own = materialize(df.where(F.col(label) == rare).select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v")), "rare")
    near = knn(own, own, "id", "v", k).select("q", "id", "rank")
    made = own.select(F.col("id").alias("q"), F.col("v").alias("qv"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    count = near.groupBy("q").agg(F.count("*").alias("n"))
    pick = (F.floor(draw(seed, "pick", F.col("q"), F.col("copy")) * F.col("n")) + 1).cast("int")
    chosen = made.join(count, "q").withColumn("rank", pick).join(near, ["q", "rank"])
    share = draw(seed, "share", F.col("q"), F.col("copy"))
    placed = chosen.join(own.withColumnRenamed("v", "nv"), "id").withColumn("share", share)
    values = [(F.col("qv")[i] + F.col("share") * (F.col("nv")[i] - F.col("qv")[i])).alias(c) for i, c in enumerate(columns)]
    return placed.select(F.col("q").alias(id_col), "copy", F.col("id").alias("neighbour"), "share", *values)


def knn_impute(df: DataFrame, id_col: str, column: str, others: list[str], k: int = 5) -> DataFrame:
    """(id, imputed): missing values of a column by the mean of the k nearest rows that have it.

    Distances are over the other columns, which have to be whole. The rows with a gap are the queries; rows are compared
    in blocks of queries against all donors.
    """
    vector = F.array(*[F.col(c).cast("double") for c in others])
    have = df.where(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), vector.alias("v"), F.col(column).cast("double").alias("t"))
    gaps = df.where(F.col(column).isNull()).select(F.col(id_col).alias("id"), vector.alias("v"))
    near = knn(gaps, have.select("id", "v"), "id", "v", k).join(have.select("id", "t"), "id")
    return near.groupBy(F.col("q").alias(id_col)).agg(F.avg("t").alias("imputed"))


def iterative_impute(df: DataFrame, columns: list[str], rounds: int = 3) -> DataFrame:
    """Missing values by regressions of each column on the others, over and over; starts from the means.

    A regression is one pass of sums over the rows that have the value; filling is a projection.
    """
    gaps = {c: F.col(c).isNull() for c in columns}
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    marked = df.withColumns({f"_gap_{c}": g for c, g in gaps.items()}).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})
    for _ in range(rounds):
        for c in columns:
            rest = [o for o in columns if o != c]
            terms = {r.term: r.coefficient for r in weighted_least_squares(marked.where(~F.col(f"_gap_{c}")).withColumn("_one", F.lit(1.0)), rest, c, "_one").collect()}
            fitted = sum((F.col(o) * terms[o] for o in rest), F.lit(terms["intercept"]))
            marked = marked.withColumn(c, F.when(F.col(f"_gap_{c}"), fitted).otherwise(F.col(c)))
        marked = materialize(marked, "imputed")
    return marked.drop(*[f"_gap_{c}" for c in columns])


def tomek_links(df: DataFrame, id_col: str, label: str, vector: str) -> DataFrame:
    """(a, b): pairs of different classes that are each other's nearest row."""
    near = knn(df, df, id_col, vector, 1).select(F.col("q").alias("a"), F.col("id").alias("b"))
    mutual = near.alias("x").join(near.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.a < x.b").select("x.a", "x.b")
    kind = df.select(F.col(id_col).alias("_i"), F.col(label).alias("_l"))
    la, lb = kind.withColumnsRenamed({"_i": "a", "_l": "la"}), kind.withColumnsRenamed({"_i": "b", "_l": "lb"})
    return mutual.join(la, "a").join(lb, "b").where("la <> lb").select("a", "b")


def bootstrap_counts(df: DataFrame, id_col: str, bags: int, seed: int = 0) -> DataFrame:
    """(rows..., bag, times): how often each row is drawn into each bag, Poisson of mean one by hash; 0 is out of bag."""
    u = draw(seed, F.col("bag"), F.col(id_col))
    times, chance, total = F.lit(0), 0.36787944117144233, 0.0
    for n in range(1, 9):
        total += chance
        times = times + (u > total).cast("int")
        chance /= n
    return df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).withColumn("times", times)


def out_of_bag(df: DataFrame, id_col: str, bags: int, seed: int = 0) -> DataFrame:
    """(rows..., bag): the rows that a bag leaves out."""
    return bootstrap_counts(df, id_col, bags, seed).where("times = 0").drop("times")
