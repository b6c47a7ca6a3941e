"""Mixing sources to target weights by weighted fair queueing.

Every source serves its documents in a shuffled order, up to `max_epochs` times over. A document (in one pass) has a
virtual finish time: the tokens its source has served by its end, divided by the source's target. All sources' documents
are ordered by finish time and the order is cut where the mix has its total budget.

Both running sums are two-level: a sum per bucket, a prefix sum over the few buckets, and a running sum inside each
bucket. Within a source the buckets are slices of the shuffle hash, in the global order slices of virtual time; both
are even by construction, so a source with a third of all rows is spread over as many buckets as any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_sums
from .selection import ROW, with_rows
from .store import WHITE_SPACE, WHITE_SPACE_RUN, materialize, sized

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Slices of each running sum. The prefix table has this many rows (and this many per source).
BUCKETS = 1024
SEED = "mix-1"


def word_count(text) -> Column:
    """Runs without ASCII white space; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WHITE_SPACE_RUN))).cast("long")


def shuffle_key(id_col: str, seed: str = SEED, text_col: str | None = None) -> Column:
    """A document's place in the shuffled order of its source: 52 bits of an MD5 digest of its id, and text if named."""
    own = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    if text_col:
        own = F.concat(own, F.lit(":"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    digest = F.md5(F.concat(F.lit(seed + ":"), own))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, rank, weight, source_size, target: the whole size shared by weight, none above max_epochs x its size.

    The excess of capped sources goes to the others by weight until none is above. Sources are ordered by their cap
    per unit of weight; the capped ones are a prefix of that order. Sizes sum per source first, so the windows here
    see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    by_cap = Window.orderBy((F.col("source_size") / F.col("weight")), "rank")
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_epochs)
        .withColumn("open_weight", F.sum("weight").over(onward))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("source_size") * max_epochs)
    )
    # The level of the first source that stays under its cap holds for all after it.
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return levels.withColumn("level", level).select(
        "source",
        "rank",
        "weight",
        "source_size",
        F.least(F.col("level") * F.col("weight"), F.col("source_size") * float(max_epochs)).alias("target"),
        F.col("total").alias("budget"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Sources are ranked by code point, null last, and weigh `weights` in turn. Null and empty texts have size 0 and
    take nothing. Rows that repeat a doc_id share its place in the order and are told apart by their size alone; a
    run on the same rows gives the same mix. An empty table gives no rows. Other columns are not read.
    """
    light = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        shuffle_key(id_col, seed).alias("place"),
        F.lit(0).cast("long").alias("row"),
    )
    return _taken(light, weights, max_epochs, buckets).drop("row")


def _taken(light: DataFrame, weights, max_epochs: int, buckets: int) -> DataFrame:
    """What the mix takes of (doc_id, source, size, place, row); rows are told apart by place, doc_id, size, row."""
    light = materialize(light, "mix-sizes")
    targets = materialize(source_targets(light, weights, max_epochs), "mix-targets")
    budget = (targets.agg(F.max("budget").alias("b")).first() or [0])[0] or 0
    # Even slices of 52-bit hashes.
    sliced = light.withColumn("slice", F.expr(f"cast(shiftright(place, 20) * {buckets} / {1 << 32} as int)"))
    served = running_sums(sliced, ["source"], "slice", ["place", "doc_id", "size", "row"], {"served": "size"})
    named = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    timed = materialize(
        served.join(sized(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "slice"), "mix-times"
    )
    passes = timed.select(
        "doc_id", "rank", "size", "place", "source_size", "target", "served", "row",
        F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"),
    ).withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("served")) / F.col("target"))
    # Past 1 a source has its whole target; what ends there cannot make the cut at the budget by more than a document.
    slots = passes.withColumn("slot", F.least(F.floor(F.col("finish") * buckets), F.lit(2 * buckets)).cast("int"))
    inside = slots.where((F.col("size") > 0) & (F.col("slot") < 2 * buckets))
    order = ["finish", "rank", "place", "doc_id", "epoch", "size", "row"]
    ranked = running_sums(inside, [], "slot", order, {"mixed": "size"})
    taken = ranked.where(F.col("mixed") <= budget).groupBy("doc_id", "rank", "size", "served", "row").agg(F.sum("size").alias("taken"))
    left, right = timed.alias("l"), taken.alias("r")
    return left.join(
        right,
        F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
        & (F.col("l.rank") == F.col("r.rank"))
        & (F.col("l.served") == F.col("r.served"))
        & (F.col("l.size") == F.col("r.size"))
        & (F.col("l.row") == F.col("r.row")),
        "left",
    ).select(
        F.col("l.doc_id"),
        F.col("l.size"),
        F.col("l.source_size"),
        F.col("l.target"),
        F.coalesce(F.col("r.taken"), F.lit(0)).cast("long").alias("taken"),
        F.col("l.row"),
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, all columns kept.

    Every row is decided by itself, whether its id is its own, shared or null: rows of one id have places of their own by
    their texts. A document without words belongs to no share and is left out.
    """
    rows = with_rows(docs)
    light = rows.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        shuffle_key(id_col, seed, text_col).alias("place"),
        F.col(ROW).alias("row"),
    )
    decided = _taken(light, weights, max_epochs, buckets).where("taken > 0")
    decided = materialize(decided.select(F.col("row").alias(ROW), (F.col("taken") / F.col("size")).cast("int").alias("__mix_times")), "mix-decided")
    joined = rows.join(sized(decided), ROW)
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times")))).drop(ROW, "__mix_times", "__mix_copy")
