"""Exact duplicates through an extendible-hash index kept in shared files.

Every text, less its ASCII white space, has a 64-bit key. The index is a directory over leading key bits: it starts as
one bucket, and any bucket with more than `capacity` entries is split by one more bit, doubling the directory where the
bucket already has its full depth, until none is overfull or `max_depth` bits are used; from there on buckets just grow.
An entry stands for all rows of one key and one digest. Owner tasks take contiguous key ranges of buckets, merge what the
reading tasks have counted, chain the entries that share a key, and name the row of each entry that stays. The rows of
chains with more than one row have their bytes fetched and compared, and every entry must be one text.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, WHITE_SPACE_RUN, materialize, sized

CAPACITY = 512
#: The directory has at most 2 ** MAX_DEPTH places (65,536 longs on the driver).
MAX_DEPTH = 16
#: Reading tasks' shares of a group of equal texts, summed before owners merge them.
SALTS = 32
#: Groups with more than this share of all rows, at most its inverse of them, are joined by broadcast.
HOT_SHARE = 1e-4


def normalized(text):
    """The compared form: the text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE_RUN, "")


def key_of(norm):
    return F.xxhash64(norm)


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One light row per document: what the index stores instead of the text."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        .select("doc_id", F.length("t").alias("points"), normalized(F.col("t")).alias("norm"))
        .select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            "points",
            key_of(F.col("norm")).alias("key"),
            F.unhex(F.sha2("norm", 256)).alias("digest"),
        )
    )


def split_buckets(held: list[int], capacity: int) -> list[tuple[int, int]]:
    """(first finest slot, local depth) of every bucket, from the entries in each of the finest slots.

    Starts with one bucket; an overfull one is split in two by its next bit, and its halves are looked at again.
    """
    max_depth = (len(held) - 1).bit_length()
    up_to = [0, *accumulate(held)]
    done, overfull = [], [(0, 0)]
    while overfull:
        first, depth = overfull.pop()
        width = len(held) >> depth
        if depth < max_depth and up_to[first + width] - up_to[first] > capacity:
            overfull += [(first + width // 2, depth + 1), (first, depth + 1)]
        else:
            done.append((first, depth))
    return done


def directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """(place, bucket, local_depth) for each place of the directory, and the directory's depth in bits.

    The bucket is named by its first place, so buckets are ordered as their key ranges are. Only counts of the finest
    slots, at most 2 ** max_depth of them, come to the driver.
    """
    held = [0] * (1 << max_depth)
    for r in entries.groupBy(slot_of(F.col("key"), max_depth).alias("slot")).agg(F.count("*").alias("n")).toLocalIterator():
        held[r.slot] = r.n
    buckets = split_buckets(held, capacity)
    depth = max(d for _, d in buckets)
    places = [
        (at, first >> (max_depth - depth), local)
        for first, local in buckets
        for at in range(first >> (max_depth - depth), (first >> (max_depth - depth)) + (1 << (depth - local)))
    ]
    return entries.sparkSession.createDataFrame(places, "place bigint, bucket bigint, local_depth int"), depth


def slot_of(key, bits: int) -> Column:
    """The leading bits of a key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Rows are equal when their texts are identical without ASCII white space. Of equal rows the one with the most
    code points in the whole text stays, then the smallest doc_id (null ids last). Null text counts as empty;
    empty texts equal each other. Of rows that repeat a doc_id and a text exactly one is kept. An empty table
    gives no rows. Only `id_col` and `text_col` are read, so other columns cannot clash.
    """
    rows = materialize(entries(docs, id_col, text_col), "dedup-entries")
    best = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("x"), "doc_id", "rid")
    # A group of any size is first summed by the tasks that read it, in shares.
    partial = rows.groupBy("key", "digest", (F.col("rid") % SALTS).alias("salt")).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    partial = materialize(partial.drop("salt"), "dedup-partial")
    places, depth = directory(partial.select("key", "digest").distinct(), capacity, max_depth)
    owners = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Owners: contiguous ranges of buckets and keys. What follows needs no other exchange.
    owned = (
        partial.withColumn("place", slot_of(F.col("key"), depth))
        .join(F.broadcast(places), "place")
        .repartitionByRange(owners, "bucket", "key")
        .groupBy("bucket", "key", "digest")
        .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    )
    in_chain = F.sum("n").over(Window.partitionBy("bucket", "key"))
    index = materialize(owned.select("bucket", "key", "digest", "best", "n", in_chain.alias("chain")), "dedup-index")

    chained = index.where("chain > 1").select("key", "bucket").distinct()
    texts = (
        docs.select(normalized(F.col(text_col)).alias("norm"))
        .select("norm", key_of(F.col("norm")).alias("key"))
        .join(sized(chained), "key")
    )
    compared = texts.groupBy("bucket", "key", "norm").agg(F.count("*").alias("size"))
    groups = compared.select("bucket", "key", F.unhex(F.sha2("norm", 256)).alias("digest"), "size")
    # Two different texts under one key and one digest would not have the entry's size: fail instead of merging them.
    proven = (
        index.where("chain > 1")
        .join(groups, ["bucket", "key", "digest"])
        .select(
            "bucket",
            "key",
            "digest",
            "best",
            F.when(F.col("n") == F.col("size"), F.col("n"))
            .otherwise(F.raise_error(F.lit("different texts share key and digest")).cast("long"))
            .alias("size"),
        )
        .where("size > 1")
    )
    copies = materialize(proven, "dedup-groups")
    total = rows.count()
    hot = copies.where(F.col("size") > max(1.0, HOT_SHARE * total))
    return _named(rows, hot, copies, total, places, depth)


def _named(rows: DataFrame, hot: DataFrame, copies: DataFrame, total: int, places: DataFrame, depth: int) -> DataFrame:
    """Every row with its group. Rows of hot groups meet theirs by broadcast, so that no key holds many rows of a join."""
    by = ["key", "digest"]
    if copies.count() <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(copies.select(*by, "best", "size")), by, "left")
    else:
        few = F.broadcast(hot.select(*by, "best", "size"))
        rest = copies.where(F.col("size") <= max(1.0, HOT_SHARE * total)).select(*by, "best", "size")
        found = rows.join(few, by).unionByName(rows.join(few.select(*by), by, "left_anti").join(rest, by, "left"), allowMissingColumns=True)
    # A row that is in no group of several is its own.
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return (
        found.withColumn("place", slot_of(F.col("key"), depth))
        .join(F.broadcast(places), "place")
        .select(
            "doc_id",
            keep.alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("size").isNull() | (F.col("rid") == F.col("best.rid"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "bucket",
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each group of equal texts, all columns kept.

    Only texts decide: rows that share a doc_id, or have none, stay apart if their texts differ.
    """
    from .selection import keep_numbered, with_ids, with_rows

    rows = with_rows(docs)
    groups = exact_groups(with_ids(rows, id_col, text_col), "id", "text")
    return keep_numbered(rows, groups.select("doc_id.row", "kept"))
