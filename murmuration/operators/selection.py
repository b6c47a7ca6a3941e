"""Choosing features, and dealing rows into folds and samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf, f_sf
from ..store import materialize, sized
from .ordering import numbered


def long_form(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., feature, value): one row per cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.feature", "_c.value")


def f_classif(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """feature, f, p: one-way analysis of variance."""
    g = long_form(df, columns, [label]).groupBy("feature", label).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = g.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("m")).alias("s"),
    )
    between, within = (F.col("q") - F.col("s") ** 2 / F.col("n")) / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))
    # A feature that the label fixes has no spread within; its F is infinite.
    f = F.when(within > 0, F.try_divide(between, within)).otherwise(float("inf"))
    return t.select("feature", f.alias("f"), f_sf(f, F.col("k") - 1, F.col("n") - F.col("k")).alias("p"))


def f_regression(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """feature, f, p of the correlation with a target."""
    r = long_form(df, columns, [target]).groupBy("feature").agg(F.corr("value", target).alias("r"), F.count("*").alias("n"))
    f = F.col("r") ** 2 / (1 - F.col("r") ** 2) * (F.col("n") - 2)
    return r.select("feature", f.alias("f"), f_sf(f, F.lit(1), F.col("n") - 2).alias("p"))


def chi2(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """feature, chi2, p: class sums of a non-negative feature against the classes' shares."""
    g = long_form(df, columns, [label]).groupBy("feature", label).agg(F.sum("value").alias("o"), F.count("*").alias("n"))
    w = Window.partitionBy("feature")
    e = g.withColumn("e", F.sum("o").over(w) * F.col("n") / F.sum("n").over(w))
    t = e.groupBy("feature").agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("chi2"), F.count("*").alias("k"))
    return t.select("feature", "chi2", chi2_sf(F.col("chi2"), F.col("k") - 1).alias("p"))


def select_k_best(scores: DataFrame, score: str, k: int) -> list[str]:
    """The k features with the largest scores (undefined ones last, ties by name)."""
    ranked = scores.orderBy(F.when(F.isnan(score), None).otherwise(F.col(score)).desc_nulls_last(), "feature")
    return [r.feature for r in ranked.limit(k).collect()]


def select_percentile(scores: DataFrame, score: str, percentile: float, n_features: int) -> list[str]:
    return select_k_best(scores, score, max(1, int(n_features * percentile / 100)))


def select_fpr(scores: DataFrame, alpha: float = 0.05) -> list[str]:
    return [r.feature for r in scores.where(F.col("p") < alpha).orderBy("feature").collect()]


def hashed_order(*columns: str, seed: int = 0) -> Column:
    """A repeatable random order: the rows' hash under a seed."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def train_test_split(df: DataFrame, order: list, test_size: float = 0.25, stratify: str | None = None) -> DataFrame:
    """Adds `is_test`: the first ceil(n * test_size) rows of an order (per class with `stratify`)."""
    placed = numbered(df, order, [stratify] if stratify else None)
    return placed.withColumn("is_test", F.col("_at") < F.ceil(F.col("_n") * test_size)).drop("_at", "_n")


def k_fold(df: DataFrame, order: list, k: int = 5) -> DataFrame:
    """Adds `fold`: contiguous blocks of an order, the first n % k one row larger."""
    at, n = F.col("_at"), F.col("_n")
    small, extra = F.floor(n / k), n % k
    cut = extra * (small + 1)
    fold = F.when(at < cut, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - cut) / small)).cast("int")
    return numbered(df, order).withColumn("fold", fold).drop("_at", "_n")


def stratified_k_fold(df: DataFrame, order: list, label: str, k: int = 5) -> DataFrame:
    """Adds `fold`: the rows of each label dealt round."""
    return numbered(df, order, [label]).withColumn("fold", (F.col("_at") % k).cast("int")).drop("_at", "_n")


def group_k_fold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Adds `fold`: whole groups, the largest first, each to the fold with the fewest rows.

    Groups of one size are told apart by their value alone, so the driver deals out sizes: it sees one row for each
    distinct size. For each it gives the folds of its groups as a list of steps that repeats, and groups look up their
    own by their place among those of that size.
    """
    sizes = materialize(df.groupBy(group).agg(F.count("*").alias("_size")), "groups")
    held, turns = [0] * k, []
    for r in sizes.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).toLocalIterator():
        at, left = 0, r.n
        # Until all folds are within one group of each other, groups go one by one; from then on in rounds of k.
        while left and max(held) - min(held) >= r._size:
            f = min(range(k), key=lambda i: (held[i], i))
            take = max(1, min(left, (sorted(held)[1] - held[f]) // r._size))
            turns.append((r._size, at, at + take, [f]))
            held[f] += take * r._size
            at, left = at + take, left - take
        if left:
            order = []
            now = list(held)
            for _ in range(k):
                f = min(range(k), key=lambda i: (now[i], i))
                order.append(f)
                now[f] += r._size
            turns.append((r._size, at, at + left, order))
            for i in range(k):
                held[order[i]] += r._size * (left // k + (i < left % k))
    table = df.sparkSession.createDataFrame(turns, "_s bigint, _from bigint, _to bigint, _folds array<int>")
    placed = numbered(sizes, [group], ["_size"])
    inside = (F.col("_size") == F.col("_s")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    step = ((F.col("_at") - F.col("_from")) % F.size("_folds") + 1).cast("int")
    dealt = placed.join(sized(table, len(turns)), inside).select(F.col(group).alias("_g"), F.element_at("_folds", step).alias("fold"))
    return df.join(sized(dealt), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def time_series_split(df: DataFrame, order: list, k: int = 5) -> DataFrame:
    """(rows..., split, part): expanding windows of train rows, each followed by a block of test rows."""
    size = F.floor(F.col("_n") / (k + 1))
    placed = numbered(df, order).withColumns({"_start": F.col("_n") - size * k, "_size": size}).drop("_n")
    split = placed.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    begin = F.col("_start") + F.col("split") * F.col("_size")
    part = F.when(F.col("_at") < begin, "train").when(F.col("_at") < begin + F.col("_size"), "test")
    return split.withColumn("part", part).where("part is not null").drop("_at", "_start", "_size")


def shuffle_split(df: DataFrame, id_col: str, n_splits: int = 3, test_size: float = 0.1, stratify: str | None = None) -> DataFrame:
    """(rows..., split, is_test): independent shuffles, each with exactly ceil(n * test_size) test rows."""
    repeated = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    by = ["split", stratify] if stratify else ["split"]
    placed = numbered(repeated, [F.xxhash64("split", id_col), id_col], by)
    return placed.withColumn("is_test", F.col("_at") < F.ceil(F.col("_n") * test_size)).drop("_at", "_n")


def under_sample(df: DataFrame, label: str, order: list) -> DataFrame:
    """As many rows of each class as the smallest class has: the first of an order."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0]
    return numbered(df, order, [label]).where(F.col("_at") < least).drop("_at", "_n")


def over_sample(df: DataFrame, label: str, order: list) -> DataFrame:
    """Rows of each class repeated in an order until it has as many as the largest class."""
    most = df.groupBy(label).count().agg(F.max("count")).first()[0]
    times = F.floor((F.lit(most) - F.col("_at") - 1) / F.col("_n")) + 1
    copies = numbered(df, order, [label]).withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    return copies.drop("_at", "_n", "_copy")


def _key_at(keys: DataFrame, at: int) -> tuple[Column | None, bool]:
    """The key at a place of the ascending order, as a struct, and whether it differs from the one before it; none beyond the last."""
    near = numbered(keys, keys.columns).where(F.col("_at").between(at - 1, at)).orderBy("_at").collect()
    if not near or near[-1]["_at"] < at:
        return None, True
    key = F.struct(*[F.lit(near[-1][f.name]).cast(f.dataType).alias(f.name) for f in keys.schema])
    return key, len(near) < 2 or near[0][: len(keys.columns)] != near[1][: len(keys.columns)]


def goss(df: DataFrame, gradient: str, id_col: str, top_rate: float = 0.2, other_rate: float = 0.1) -> DataFrame:
    """Rows with the largest gradients, and of the others a part in hash order, weighted up by (1 - a) / b.

    Only the keys of the two orders are ranged; rows are held against the keys where the orders are cut, and stay where
    they stand. Should a cut fall between rows of one key, whole rows are numbered.
    """
    others = (1 - top_rate) / other_rate
    by_gradient = df.select((-F.abs(F.col(gradient))).alias("a"), F.col(id_col).alias("b"))
    n = by_gradient.count()
    first, clean = _key_at(by_gradient, math.floor(n * top_rate))
    if clean:
        large = F.lit(True) if first is None else F.struct((-F.abs(F.col(gradient))).alias("a"), F.col(id_col).alias("b")) < first
        second, clean = _key_at(df.where(~large).select(F.xxhash64(id_col).alias("a"), F.col(id_col).alias("b")), math.floor(n * other_rate))
    if clean:
        chosen = F.lit(True) if second is None else F.struct(F.xxhash64(id_col).alias("a"), F.col(id_col).alias("b")) < second
        return df.withColumn("weight", F.when(large, F.lit(1.0)).when(chosen, F.lit(others))).where("weight is not null")
    top, other = F.floor(F.col("_n") * top_rate), F.floor(F.col("_n") * other_rate)
    ranked = numbered(df, [-F.abs(F.col(gradient)), id_col])
    large = ranked.where(F.col("_at") < top).withColumn("weight", F.lit(1.0)).drop("_at", "_n")
    rest = ranked.where(F.col("_at") >= top).withColumn("_want", other).drop("_at", "_n")
    chosen = numbered(rest, [F.xxhash64(id_col), id_col]).where(F.col("_at") < F.col("_want"))
    return large.unionByName(chosen.withColumn("weight", F.lit(others)).drop("_at", "_n", "_want"))