"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, release


def _open(edges: DataFrame) -> bool:
    """Whether a node has two smaller neighbours, or one that has a smaller one itself."""
    per = edges.groupBy("u").agg(F.count("*").alias("c"))
    chained = edges.select("v").distinct().join(per.select(F.col("u").alias("v")), "v", "left_semi")
    return not per.where("c > 1").select(F.col("u").alias("v")).limit(1).unionByName(chained.limit(1)).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of (a, b), the smallest node it is connected with.

    Each round joins every node's larger neighbours to the smallest one (large star), then its smaller neighbours
    (small star), until every edge leads from a node of its own to a least one: a logarithmic number of rounds for any
    shape, none for stars. Only minima per node are aggregated, so a hub is pre-summed in its own partitions, and rounds
    are cut by tables in the shared folder.
    """
    spark = edges.sparkSession
    current = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    current = materialize(current.distinct(), "stars")
    while _open(current):
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above a node link to the least around it.
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # Small star: a node and its smaller neighbours link to the least of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = materialize(small, "stars")
        release(spark, current)
        current = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
