"""Frequent itemsets, association rules, sequences, Markov chains and probability tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize, sized


def frequent_itemsets(baskets: DataFrame, items: str, min_support: float = 0.1, max_size: int | None = None) -> DataFrame:
    """(items, n, support): itemsets in at least min_support of the baskets, by level-wise joins of frequent sets.

    Level k joins each basket's frequent (k-1)-sets with its frequent larger items, so only candidates with a frequent
    prefix are ever made, and counts are summed where they arise.
    """
    # Written, so that a basket keeps its number whatever is lost.
    df = materialize(baskets.select(F.monotonically_increasing_id().alias("_b"), F.array_distinct(items).alias("_i")), "baskets")
    n = df.count()
    flat = df.select("_b", F.explode("_i").alias("item"))
    least = min_support * n
    single = materialize(flat.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least), "counts")
    kept = materialize(flat.join(sized(single.select("item")), "item", "left_semi"), "items")
    level = kept.select("_b", F.array("item").alias("items"))
    found = single.select(F.array("item").alias("items"), "n")
    size = 1
    while max_size is None or size < max_size:
        grown = level.join(kept, "_b").where(F.col("item") > F.element_at("items", -1)).select("_b", F.concat("items", F.array("item")).alias("items"))
        counts = materialize(grown.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= least), "counts")
        some = counts.count()
        if not some:
            break
        found, size = found.unionByName(counts), size + 1
        if max_size is None or size < max_size:
            level = materialize(grown.join(sized(counts.select("items"), some), "items", "left_semi"), "sets")
    return found.select("items", "n", (F.col("n") / float(n or 1)).alias("support"))


def eclat(baskets: DataFrame, items: str, id_col: str, min_support: float = 0.1, max_size: int | None = None) -> DataFrame:
    """(items, n, support): the same itemsets from the vertical form, by intersecting sets of basket ids.

    A set is its rows (items, last, basket). Two sets of one prefix meet on their baskets, so an intersection is a join
    on (prefix, basket), and no set of ids is gathered.
    """
    flat = materialize(baskets.select(F.col(id_col).alias("b"), F.explode(F.array_distinct(items)).alias("last")), "tids")
    n = baskets.count()
    least = min_support * n

    def frequent(level: DataFrame) -> tuple[DataFrame, DataFrame]:
        counts = materialize(level.groupBy("prefix", "last").agg(F.count("*").alias("n")).where(F.col("n") >= least), "counts")
        return materialize(level.join(sized(counts.select("prefix", "last")), ["prefix", "last"], "left_semi"), "tids"), counts

    level, counts = frequent(flat.select(F.array().cast("array<string>").alias("prefix"), "last", "b"))
    found, size = counts, 1
    while max_size is None or size < max_size:
        x, y = level.alias("x"), level.alias("y")
        met = x.join(y, (F.col("x.prefix") == F.col("y.prefix")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.last") < F.col("y.last")))
        level, counts = frequent(met.select(F.concat("x.prefix", F.array("x.last")).alias("prefix"), F.col("y.last").alias("last"), F.col("x.b").alias("b")))
        if counts.isEmpty():
            break
        found, size = found.unionByName(counts), size + 1
    return found.select(F.concat("prefix", F.array("last")).alias("items"), "n", (F.col("n") / float(n or 1)).alias("support"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.5, min_lift: float = 1.0) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift) over every split of every frequent itemset."""
    multi = itemsets.where(F.size("items") > 1)
    # Subsets by bit mask: itemsets are short.
    masks = multi.withColumn("_m", F.explode(F.sequence(F.lit(1), F.expr("cast(shiftleft(1, size(items)) - 2 as int)"))))
    side = lambda keep: F.expr(f"filter(items, (x, i) -> (shiftright(_m, i) & 1) = {keep})")
    split = masks.select(side(1).alias("antecedent"), side(0).alias("consequent"), "support")
    a = itemsets.select(F.col("items").alias("antecedent"), F.col("support").alias("sa"))
    c = itemsets.select(F.col("items").alias("consequent"), F.col("support").alias("sc"))
    scored = split.join(a, "antecedent").join(c, "consequent")
    confidence = F.col("support") / F.col("sa")
    return scored.select("antecedent", "consequent", "support", confidence.alias("confidence"), (confidence / F.col("sc")).alias("lift")).where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def transitions(df: DataFrame, state: str, order: list, by: list[str], alpha: float = 1.0) -> DataFrame:
    """(a, b, n, p): smoothed transition probabilities of a Markov chain over all pairs of states."""
    w = Window.partitionBy(*by).orderBy(*order)
    moves = df.select(F.col(state).alias("a"), F.lead(state).over(w).alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    states = df.select(F.col(state).alias("s")).distinct()
    grid = states.select(F.col("s").alias("a")).crossJoin(F.broadcast(states.select(F.col("s").alias("b"))))
    full = grid.join(moves, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("p", (F.col("n") + alpha) / F.sum(F.col("n") + alpha).over(Window.partitionBy("a")))


def conditional_table(df: DataFrame, variable: str, parents: list[str], alpha: float = 1.0) -> DataFrame:
    """(parents..., variable, p): smoothed conditional probabilities over the values that occur."""
    values = df.select(variable).distinct()
    combos = df.select(*parents).distinct() if parents else None
    counts = df.groupBy(*parents, variable).agg(F.count("*").alias("n"))
    grid = values if combos is None else combos.crossJoin(F.broadcast(values))
    full = grid.join(counts, [*parents, variable], "left").withColumn("n", F.coalesce("n", F.lit(0)) + alpha)
    return full.select(*parents, variable, (F.col("n") / F.sum("n").over(Window.partitionBy(*parents))).alias("p"))


def multiply(a: DataFrame, b: DataFrame, value: str = "p") -> DataFrame:
    """Product of two factors: join on the shared variables."""
    shared = [c for c in a.columns if c in b.columns and c != value]
    right = b.withColumnRenamed(value, "_q")
    joined = a.join(right, shared) if shared else a.crossJoin(right)
    return joined.withColumn(value, F.col(value) * F.col("_q")).drop("_q")


def marginalize(a: DataFrame, out: list[str], value: str = "p") -> DataFrame:
    """A factor summed over some variables."""
    return a.groupBy(*[c for c in a.columns if c not in (*out, value)]).agg(F.sum(value).alias(value))


def reduce_factor(a: DataFrame, evidence: dict, value: str = "p") -> DataFrame:
    """A factor with some variables fixed."""
    for v, x in evidence.items():
        if v in a.columns:
            a = a.where(F.col(v) == x).drop(v)
    return a


def eliminate(factors: list[DataFrame], query: list[str], evidence: dict | None = None, value: str = "p") -> DataFrame:
    """The normalised distribution of some variables: each other variable is summed out of the product it is in."""
    factors = [reduce_factor(f, evidence or {}, value) for f in factors]
    hidden = sorted({c for f in factors for c in f.columns} - {*query, value})
    for h in hidden:
        using = [f for f in factors if h in f.columns]
        product = using[0]
        for f in using[1:]:
            product = multiply(product, f, value)
        factors = [f for f in factors if h not in f.columns] + [marginalize(product, [h], value)]
    product = factors[0]
    for f in factors[1:]:
        product = multiply(product, f, value)
    return product.withColumn(value, F.col(value) / F.sum(value).over(Window.partitionBy()))


def mutual_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, mi) for every pair of columns, from one pass over pairs of values."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).cast("string").alias("u"), F.col(y).cast("string").alias("v")) for x, y in pairs])
    c = df.select(F.explode(cells).alias("e")).select("e.*").groupBy("a", "b", "u", "v").agg(F.count("*").alias("n"))
    w = lambda *k: Window.partitionBy("a", "b", *k)
    t = c.withColumns({"nu": F.sum("n").over(w("u")), "nv": F.sum("n").over(w("v")), "nn": F.sum("n").over(w())})
    return t.groupBy("a", "b").agg(F.sum(F.col("n") / F.col("nn") * F.ln(F.col("n") * F.col("nn") / (F.col("nu").cast("double") * F.col("nv")))).alias("mi"))


def chow_liu(df: DataFrame, columns: list[str]) -> list[tuple[str, str, float]]:
    """The maximum spanning tree over pairwise mutual information: one small table comes to the driver."""
    ranked = sorted(mutual_information(df, columns).collect(), key=lambda r: (-r.mi, r.a, r.b))
    group = {c: c for c in columns}

    def find(c):
        while group[c] != c:
            c = group[c]
        return c

    tree = []
    for r in ranked:
        if find(r.a) != find(r.b):
            group[find(r.a)] = find(r.b)
            tree.append((r.a, r.b, r.mi))
    return tree


def slope_one(ratings: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """(i, j, dev, n): mean difference of the ratings of two items by the users who rated both."""
    r = materialize(ratings.select(F.col(user).alias("u"), F.col(item).alias("i"), F.col(rating).alias("r")), "ratings")
    a = r.select("u", "i", F.col("r").alias("ri"))
    b = r.select("u", F.col("i").alias("j"), F.col("r").alias("rj"))
    return a.join(b, "u").where("i <> j").groupBy("i", "j").agg(F.avg(F.col("ri") - F.col("rj")).alias("dev"), F.count("*").alias("n"))


def slope_one_predict(deviations: DataFrame, ratings: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """(u, i, predicted) for items a user has not rated: deviations weighted by their number of raters.

    Ratings stand with their user before they meet the deviations, so what a user gets of each item is summed in place.
    """
    mine = ratings.select(F.col(user).alias("u"), F.col(item).alias("j"), F.col(rating).alias("r")).repartition("u")
    p = mine.join(sized(with_own(materialize(deviations, "deviations"))), "j").groupBy("u", "i")
    predicted = p.agg((F.sum((F.col("r") + F.col("dev")) * F.col("n")) / F.sum("n")).alias("predicted"), F.max("own").alias("own"))
    return predicted.where("own is null").select("u", "i", "predicted")


def with_own(between: DataFrame) -> DataFrame:
    """(i, j, ...) with a row (i, i, nulls, own: true) for each i: who has rated i meets it there, without another join."""
    own = between.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(True).alias("own"))
    return between.unionByName(own, allowMissingColumns=True)


def pareto_front(df: DataFrame, objectives: list[str], id_col: str) -> DataFrame:
    """Rows that no other row dominates (all objectives are minimised).

    Rows are thinned first by the 64 with the smallest sums of objectives, which beat most of the others.
    """
    distinct = df.groupBy(*objectives).agg(F.min(id_col).alias("_i"))
    best = distinct.orderBy(sum((F.col(o) for o in objectives), F.lit(0.0)), *objectives).limit(64)
    beats = lambda x, y: (
        _all([F.col(f"{x}.{o}") <= F.col(f"{y}.{o}") for o in objectives]) & _any([F.col(f"{x}.{o}") < F.col(f"{y}.{o}") for o in objectives])
    )
    thin = distinct.alias("y").join(F.broadcast(best.alias("x")), beats("x", "y"), "left_anti")
    front = thin.alias("y").join(thin.alias("x"), beats("x", "y"), "left_anti")
    return df.join(front.select(*objectives), objectives, "left_semi")


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def crowding_distance(df: DataFrame, objectives: list[str], by: list[str], id_col: str) -> DataFrame:
    """Normalised gaps to the neighbours in every objective within a front; the ends are infinite."""
    every = Window.partitionBy(*by)
    total = F.lit(0.0)
    for o in objectives:
        w = every.orderBy(o, id_col)
        span = F.max(o).over(every) - F.min(o).over(every)
        gap = (F.lead(o).over(w) - F.lag(o).over(w)) / F.when(span == 0, 1.0).otherwise(span)
        total = total + F.coalesce(gap, F.lit(float("inf")))
    return df.withColumn("crowding", total)
