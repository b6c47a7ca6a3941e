"""Contiguous shards of near equal bytes, from prefix sums over partitions.

The light rows (id, size, digests) are range-sorted; each range partition has a total; the prefix sum of those totals
gives every partition its base, and a running sum inside it every document its place in the corpus. Shard borders are
the equal cuts of the whole size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

SHARDS = 8
#: A border moves to the end of a group of equal texts if that shifts it by no more than this share of a shard.
SNAP = 0.01


def byte_size(text):
    """UTF-8 bytes and one separator; null has the separator alone."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def borders(placed: DataFrame, total: int, n_shards: int, snap: float) -> list[float]:
    """The n_shards - 1 cuts in bytes, each moved to the end of the group of equal texts that it cuts if that is near.

    The driver sees only those groups: at most one per cut.
    """
    cuts = [total * k / n_shards for k in range(1, n_shards)]
    if not total or not cuts:
        return cuts
    start = F.col("end") - F.col("size")
    at_cut = [(start < c) & (F.col("end") >= c) for c in cuts]
    hit = placed.where(at_any(at_cut)).select("text_crc32", "digest").distinct()
    groups = (
        placed.join(F.broadcast(hit), ["text_crc32", "digest"])
        .groupBy("text_crc32", "digest")
        .agg(F.min(start).alias("low"), F.max("end").alias("high"))
        .collect()
    )
    moved = []
    for c in cuts:
        ends = [e for g in groups if g.low < c < g.high for e in (g.low, g.high)]
        near = min(ends, key=lambda e: abs(e - c), default=c)
        moved.append(near if abs(near - c) <= snap * total / n_shards else c)
    return moved


def at_any(conditions):
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return found


def _shard(cuts: list[float]):
    """The number of borders before a document's middle."""
    middle = F.col("end") - F.col("size") / 2
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (middle > F.lit(float(c))).cast("int")
    return shard


def shards(
    docs: DataFrame,
    n_shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    snap: float = SNAP,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot (place in its shard, from 0).

    The order is by digest of the text, then a hash of the id, then the id, so equal texts stand together and a group
    of any size can be cut. A border inside a group of equal texts moves to the group's nearer end when that costs at
    most `snap` of a shard; larger groups are cut, as sizes must stay equal. Null and empty texts have size 1; null
    ids come first; repeated rows get places of their own. Fewer rows than shards leave shards empty, an empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(
        F.col(id_col).alias("doc_id"),
        byte_size(F.col(text_col)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("digest"),
    ).withColumn("salt", F.xxhash64("doc_id"))
    order = ["text_crc32", "digest", "salt", "doc_id"]
    # The ranges are fixed by writing them: a recomputed sample could cut elsewhere.
    ranged = materialize(
        light.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()),
        "shard-ranges",
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"))
    bases = totals.select("part", (F.sum("bytes").over(Window.orderBy("part")) - F.col("bytes")).alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(F.broadcast(bases), "part").withColumn("end", F.sum("size").over(inside) + F.col("base"))
    total = totals.agg(F.sum("bytes")).first()[0] or 0
    sharded = placed.withColumn("shard", _shard(borders(placed, total, n_shards, snap)))
    counts = sharded.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.select(
        "shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start")
    )
    place = Window.partitionBy("shard", "part").orderBy(*order)
    return sharded.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.row_number().over(place) - 1 + F.col("start")).cast("long").alias("slot"),
    )
