"""Which of a group of near copies stays: SimHash balls and bands of minimum hashes nominate, shingles decide.

Texts with one set of shingles are one class and travel once. SimHash fingerprints of the sets meet by ball hashing, and
a spanning forest of their links is compared first. At a Jaccard similarity of 0.8 two fingerprints are some ten bits
apart, beyond what balls of half the radius can reach, so bands stand beside them: each of BANDS keys joins ROWS minimum
hashes of a text's shingles; two texts with a similarity of s share a given key with probability s ** ROWS, so at s = 0.8
one pair in 20 million shares none of the 32.

Within a key, a few pivots are compared with all others, which connects what crowds around them. What is left over, copies
edited too far for the pivots, is joined on rare shingles with bounds on what a pair can share, so that it is not compared
with every member of the crowd. The bounds are exact: no pair of a key is skipped that could still change the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Memory
from .components import connected_components
from .hashing import mixed as _mixed
from .simhash import links
from .store import WHITE_SPACE, WHITE_SPACE_RUN, materialize, sized

BANDS = 32
ROWS = 4
GROUP = 256
#: Shingles hashed at once, for all minimum hashes.
BLOCK = 2048
#: Pivots of a key in each round.
PIVOTS = (1, 2)
_random = np.random.default_rng(20)
_STEP = _random.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_TIMES = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_PLUS = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_words: list[Memory] = []


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, from the hashes of its words; fewer words make one shingle."""
    n, size = max(len(words) - size + 1, 1), min(size, len(words))
    found = np.full(n, size, np.uint64)
    for k in range(size):
        found += _mixed(words[k : k + n] + _STEP[k % len(_STEP)]) * _STEP[-1 - k % len(_STEP)]
    return np.unique(_mixed(found))


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes: a bit is set if more than half of them have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), BLOCK):
        bits = np.unpackbits(shingles[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view(np.int64)[0])


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """For each of BANDS * ROWS hash functions its least value over the shingles."""
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    parts = (upper[at : at + BLOCK, None] * _TIMES + _PLUS for at in range(0, len(upper), BLOCK))
    return reduce(np.minimum, (p.min(axis=0) for p in parts))


def signatures(rows: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n (distinct shingles), c1 and c2 (128 bits of their set), fp (their SimHash), bands: for every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        if not _words:
            _words.append(Memory(lambda some: [xxhash.xxh64_intdigest(w) for w in some]))
        memory = _words[0]
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                texts = [t.split() or [b""] for t in some.column(1).to_pylist()]
                memory.prepare(set().union(*texts))
                known, sums, least, prints = memory.young, [], [], []
                for t in texts:
                    s = shingle_hashes(np.fromiter(map(known.__getitem__, t), np.uint64, len(t)), words)
                    sums.append((len(s), s.sum(dtype=np.uint64), _mixed(s + _STEP[1]).sum(dtype=np.uint64)))
                    least.append(least_hashes(s))
                    prints.append(set_fingerprint(s))
                rows = np.array(least).reshape(-1, BANDS, ROWS).astype(np.uint64)
                keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP[2] + np.zeros((len(texts), 1), np.uint64)
                for k in range(ROWS):
                    keys = _mixed(keys + rows[:, :, k] * _STEP[3 + k])
                n, c1, c2 = zip(*sums)
                ends = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array(np.array(n, np.int64)),
                        pa.array(np.array(c1, np.uint64).view(np.int64)),
                        pa.array(np.array(c2, np.uint64).view(np.int64)),
                        pa.array(prints, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["id", "n", "c1", "c2", "fp", "bands"],
                )

    # The same lower case and white space as in shingle_sets.
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary")
    return rows.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).mapInArrow(
        run, "id bigint, n bigint, c1 bigint, c2 bigint, fp bigint, bands array<bigint>"
    )


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id and s, the distinct hashes of the word shingles (the whole sequence where there are fewer words)."""
    split = F.split(F.btrim(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WHITE_SPACE)), WHITE_SPACE_RUN)
    grams = f"array_distinct(transform(sequence(1, greatest(size(w) - {words - 1}, 1)), i -> xxhash64(slice(w, i, {words}))))"
    return docs.select(F.col(id_col).alias("doc_id"), split.alias("w")).select("doc_id", F.expr(grams).alias("s"))


def shared_counts(sets: DataFrame) -> DataFrame:
    """id, n (shingles), m (those that another of these classes has as well)."""
    flat = sets.select(F.col("doc_id").alias("id"), F.explode("s").alias("h"))
    alone = flat.groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
    sizes = sets.select(F.col("doc_id").alias("id"), F.size("s").cast("long").alias("n"))
    return sizes.join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"))


def similar_at_most(n, m, other, threshold: float):
    """Whether a class of n shingles, m of them shared, can be near one of `other` shingles: m bounds what they share."""
    return m * (1 + threshold) + 1e-6 >= threshold * (n + other)


def near_pairs(first: DataFrame, shared: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): near classes, enough pairs to connect all that are near and share a key, or are a pair of `first`.

    `shared` is (key, id, n, m). A round takes the PIVOTS cleanest classes of a key that are not in its largest component
    and compares each with all other components of the key; then they leave it. Classes that nothing in the key can be
    near leave as well, and a key is done when one component is left in it. What two rounds leave in keys goes through
    an exact join on rare shingles.
    """

    def judged(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(
            sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b"
        )
        common = F.size(F.array_intersect("sa", "sb"))
        found = both.select("a", "b", (common >= threshold * (F.size("sa") + F.size("sb") - common)).alias("near"))
        return materialize(found, "near-judged")

    compared = judged(first)
    for pivots in (*PIVOTS, None):
        near = compared.where("near").select("a", "b")
        member = connected_components(near)
        named = shared.join(member, shared["id"] == member["node"], "left").select(
            "key", "id", "n", "m", F.coalesce("component", "id").alias("part")
        )
        key, part = Window.partitionBy("key"), Window.partitionBy("key", "part")
        least = F.greatest(F.min("n").over(key), F.col("n") * threshold)
        viable = named.withColumn("least", least).where(similar_at_most(F.col("n"), F.col("m"), F.col("least"), threshold)).drop("least")
        parted = viable.withColumn("other", F.min("part").over(key) != F.max("part").over(key)).where("other")
        sized_parts = parted.withColumn("k", F.count("*").over(part))
        top = F.max(F.struct("k", "part")).over(key)["part"] == F.col("part")
        placed = sized_parts.withColumn("top", top).withColumn("place", F.row_number().over(key.orderBy("top", F.col("n") - F.col("m"), "id")))
        placed = materialize(placed.select("key", "id", "n", "m", "part", "top", "place"), "near-places")
        if placed.isEmpty():
            return near
        if pivots is None:
            rest = placed.groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "m", "part")], (~F.min("top")).alias("aside"))
            pairs = rare_pairs(materialize(rest, "near-rest"), sets, threshold)
            more = judged(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti"))
            return near.unionByName(more.where("near").select("a", "b"))
        chosen = F.col("place") <= pivots
        p = placed.where(chosen).select(
            "key", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("m").alias("pm"), F.col("part").alias("pp"), F.col("place").alias("at")
        )
        alike = (F.least("n", "pn") >= threshold * F.greatest("n", "pn")) & similar_at_most(F.col("n"), F.least("m", "pm"), F.col("pn"), threshold)
        met = placed.join(p, "key").where("part <> pp AND place > at").where(alike)
        pairs = met.select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
        compared = compared.unionByName(judged(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")))
        shared = placed.where(~chosen).select("key", "id", "n", "m")


def rare_pairs(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of different components that can be near, by their rarest shingles.

    Every class lists its shingles from the rarest on; two near classes have one in common among the first
    n - ceil(threshold * n) + 1 of both. What stands behind the first common shingle bounds what they share, so a class
    full of shingles of its own meets only those that have the same ones. One side of a pair is not in the largest
    component of some key (`aside`).
    """
    listed = sets.join(sized(rest.select("id")), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), F.explode("s").alias("h"))
    listed = materialize(listed, "near-listed")
    often = sized(listed.groupBy("h").agg(F.count("*").alias("c")))
    order = Window.partitionBy("id").orderBy("c", "h")
    ranked = listed.join(often, "h").withColumn("at", F.row_number().over(order))
    begins = ranked.join(sized(rest), "id").where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-6) + 1)
    begins = materialize(begins.select("h", "id", "at", "n", "m", "part", "aside"), "near-begins")
    x = begins.where("aside").select("h", *[F.col(c).alias(f"x_{c}") for c in ("id", "at", "n", "m", "part")])
    y = begins.drop("aside")
    behind = F.least(F.col("n") - F.col("at"), F.col("x_n") - F.col("x_at"), F.col("m") - 1, F.col("x_m") - 1) + 1
    met = x.join(y, "h").where("part <> x_part").where(F.least("n", "x_n") >= threshold * F.greatest("n", "x_n"))
    met = met.where(similar_at_most(F.col("n"), behind, F.col("x_n"), threshold))
    return met.select(F.least("id", "x_id").alias("a"), F.greatest("id", "x_id").alias("b")).distinct()


def ball_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): classes whose SimHash fingerprints are equal or linked by ball hashing, enough pairs to connect all such."""
    prints = materialize(classes.groupBy("fp").agg(F.min("id").alias("a"), F.count("*").alias("held")), "near-prints")
    same = classes.join(sized(prints.where("held > 1")), "fp").where("id <> a").select("a", F.col("id").alias("b"))
    met = links(prints.select("fp"))
    at_a = prints.select(F.col("fp").alias("fa"), F.col("a").alias("ia"))
    at_b = prints.select(F.col("fp").alias("fb"), F.col("a").alias("ib"))
    linked = met.join(at_a, met["a"] == at_a["fa"]).join(at_b, met["b"] == at_b["fb"])
    return materialize(same.unionByName(linked.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))), "near-balls")


def near_copies(rows: DataFrame, row_col: str, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """(row, kept): each row that is near another one; of every component the one with the smallest id is kept.

    `row_col` is a long that names each row of a table which reads the same each time. Rows without id are not
    compared. Near are rows whose sets of shingles have a Jaccard similarity of `threshold` or more.
    """
    named = rows.where(F.col(id_col).isNotNull())
    signed = materialize(signatures(named, row_col, text_col, words), "near-signatures")
    classes = materialize(
        signed.groupBy("n", "c1", "c2").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.min("fp").alias("fp")), "near-classes"
    )
    balls = ball_pairs(classes.select("id", "fp"))
    keys = signed.join(classes.select("id"), "id", "left_semi").select("id", F.explode("bands").alias("key"))
    keys = materialize(keys, "near-keys")
    crowded = materialize(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "near-crowded")
    shared = materialize(keys.join(sized(crowded), "key", "left_semi"), "near-shared")
    wanted = shared.select("id").unionByName(balls.select(F.explode(F.array("a", "b")).alias("id")))
    wanted = materialize(wanted.select(F.col("id").alias("wanted")).distinct(), "near-wanted")
    texts = named.select(F.col(row_col).alias("id"), F.col(text_col).alias("text")).join(sized(wanted), F.col("id") == F.col("wanted"), "left_semi")
    sets = materialize(shingle_sets(texts, "id", "text", words), "near-shingles")
    counts = shared_counts(sets).where(F.col("m") + 1e-6 >= threshold * F.col("n"))
    counts = materialize(counts, "near-counts")
    some = sized(counts)
    shared = materialize(shared.join(some, "id"), "near-shared")
    at_a, at_b = (counts.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("m").alias("m" + x)) for x in "ab")
    first = balls.join(sized(at_a), "a").join(sized(at_b), "b").where(similar_at_most(F.col("na"), F.least("ma", "mb"), F.col("nb"), threshold))
    member = connected_components(near_pairs(first.select("a", "b"), shared, sets, threshold))
    # All rows of a class are in the component of the class.
    whole = classes.join(member, classes["id"] == member["node"], "left").where("rows > 1 OR component IS NOT NULL")
    whole = materialize(whole.select("n", "c1", "c2", F.coalesce("component", "id").alias("part")), "near-parts")
    found = signed.select("id", "n", "c1", "c2").join(sized(whole), ["n", "c1", "c2"]).select(F.col("id").alias("row"), "part")
    ids = rows.select(F.col(row_col).alias("row"), F.col(id_col).alias("name"))
    found = materialize(found.join(ids, "row"), "near-found")
    first = found.groupBy("part").agg(F.min(F.struct("name", "row")).alias("first"))
    return found.join(first, "part").select("row", (F.col("row") == F.col("first.row")).alias("kept"))
