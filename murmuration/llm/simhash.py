"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 2r or less share a value within r of both. So every distinct fingerprint emits all
values within r of itself, the values are shuffled, and fingerprints that meet in a value are linked.

With r = 2 a fingerprint has 2,081 variants. They are not written out one by one: variants that agree in their leading
`prefix` bits go to the same place, so a fingerprint travels once per reachable prefix (37 times for 8 bits) with the
flips it has left, and the task that owns the prefix emits the variants themselves, sorts them and reads off the
meetings. The prefix grows with the number of fingerprints, so that a place gets about as many at any size of the
corpus; inside a task a crowded prefix is split by further bits. Within one value the meeting fingerprints are chained, not
paired, every chained pair has its distance checked, and of all checked pairs of a place only a spanning forest leaves
the task: n fingerprints give n - 1 links at most, however dense they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialize

SHINGLE = 4
RADIUS = 2
SEED = 42
#: Leading bits that decide where variants meet, at least and at most, and the mean rows that a place may get.
PREFIX_BITS = 8
MOST_PREFIX_BITS = 24
PLACE_ROWS = 1 << 18
#: Variants a task holds at once (8 bytes each, and as much again to sort them).
CHUNK = 1 << 22
#: Shingle hashes counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text: a bit is set if more than half of its shingles' XXH64 have it; no words: 0."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))
    starts = (ends - np.fromiter(map(len, tokens), np.int64, len(tokens))).tolist()
    stops = ends.tolist()[words - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(stops), BLOCK):
        hashed = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])]
        bits = np.unpackbits(np.array(hashed, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(2 * counts > len(stops), bitorder="little")
    return int(chosen.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp bigint"
    )


def flips(bits: int, most: int) -> dict[int, np.ndarray]:
    """By count: all values of `bits` bits with so many set."""
    found: dict[int, list[int]] = {0: [0]}
    for n in range(1, most + 1):
        found[n] = [x | 1 << b for x in found[n - 1] for b in range(x.bit_length(), bits)]
    return {n: np.array(x, np.uint64) for n, x in found.items()}


def reach(fps: DataFrame, prefix: int = PREFIX_BITS, radius: int = RADIUS) -> DataFrame:
    """(place, fp, left): the prefixes that a fingerprint's variants have, and the flips left for the other bits."""
    masks = [(int(m), n) for n, group in flips(prefix, radius).items() for m in group]
    choice = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(radius - n).alias("left")) for m, n in masks])
    top = F.shiftrightunsigned("fp", 64 - prefix).cast("int")
    return fps.select("fp", top.alias("top"), F.explode(choice).alias("c")).select(
        F.col("top").bitwiseXOR(F.col("c.m")).cast("int").alias("place"), "fp", F.col("c.left").alias("left")
    )


def variants(fp: np.ndarray, left: np.ndarray, bits: int, masks: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values within `left` flips of each fingerprint in its lower `bits` bits, and the index of its owner."""
    low = fp & np.uint64((1 << bits) - 1)
    values, owners = [], []
    for n in np.unique(left):
        at = np.flatnonzero(left == n)
        ball = np.concatenate([masks[k] for k in range(int(n) + 1)])
        values.append((low[at][:, None] ^ ball[None, :]).ravel())
        owners.append(np.repeat(at, len(ball)))
    return np.concatenate(values), np.concatenate(owners)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The places of the edges (a, b) between n nodes that make a spanning forest: every tree takes its first edge out."""
    tree, chosen, open_edges = np.arange(n), [], np.arange(len(a))
    while True:
        open_edges = open_edges[tree[a[open_edges]] != tree[b[open_edges]]]
        if not len(open_edges):
            return np.unique(np.concatenate(chosen)) if chosen else open_edges
        first = np.full(n, len(a))
        np.minimum.at(first, tree[a[open_edges]], open_edges)
        np.minimum.at(first, tree[b[open_edges]], open_edges)
        own = np.flatnonzero(first < len(a))
        edge = first[own]
        chosen.append(edge)
        # Each tree hangs on the one at the other end of its edge; of two that chose the same edge the smaller stays.
        other = np.where(tree[a[edge]] == own, tree[b[edge]], tree[a[edge]])
        up = np.arange(n)
        up[own] = other
        both = up[up] == np.arange(n)
        up[both & (np.arange(n) < up)] = np.flatnonzero(both & (np.arange(n) < up))
        while (up[up] != up).any():
            up = up[up]
        tree = up[tree]


def meetings(fp: np.ndarray, left: np.ndarray, bits: int, chunk: int = CHUNK, most: int = 2 * RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of fingerprints that meet in a value whose bits above `bits` are settled, a spanning forest of them.

    Splits on a bit if crowded. Linked are different fingerprints of `most` differing bits or fewer.
    """
    if len(fp) < 2:
        return
    size = sum(_ball(bits, int(n)) * int((left == n).sum()) for n in np.unique(left))
    if size > chunk and bits > 0:
        bit = (fp >> np.uint64(bits - 1)) & np.uint64(1)
        for side in (0, 1):
            rest = left - (bit != side)
            here = rest >= 0
            yield from meetings(fp[here], rest[here], bits - 1, chunk, most)
        return
    masks = _masks(bits, int(left.max()))
    value, owner = variants(fp, left, bits, masks)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    a, b = owner[same], owner[same + 1]
    key = np.unique(np.minimum(a, b) * len(fp) + np.maximum(a, b))
    a, b = key // len(fp), key % len(fp)
    apart = np.bitwise_count(fp[a] ^ fp[b])
    near = (apart <= most) & (apart > 0)
    a, b = a[near], b[near]
    kept = forest(a, b, len(fp))
    if len(kept):
        yield np.minimum(fp[a], fp[b])[kept], np.maximum(fp[a], fp[b])[kept]


def _ball(bits: int, radius: int) -> int:
    from math import comb

    return sum(comb(bits, k) for k in range(radius + 1))


_known: dict[tuple[int, int], dict[int, np.ndarray]] = {}


def _masks(bits: int, most: int) -> dict[int, np.ndarray]:
    if (bits, most) not in _known:
        _known[bits, most] = flips(bits, most)
    return _known[bits, most]


def prefix_bits(count: int, radius: int = RADIUS, rows: int = PLACE_ROWS) -> int:
    """The fewest leading bits with which `count` fingerprints send a place no more than `rows` rows on average."""
    enough = (p for p in range(PREFIX_BITS, MOST_PREFIX_BITS) if count * _ball(p, radius) <= rows << p)
    return next(enough, MOST_PREFIX_BITS)


def links(fps: DataFrame, radius: int = RADIUS, prefix: int | None = None) -> DataFrame:
    """(a, b): checked links between distinct fingerprints, enough of them to connect all within 2 * radius bits.

    A place gives no more links than it has fingerprints.

    Without a `prefix` the fingerprints are counted to choose it; it changes where they meet, not which are linked.
    """
    if prefix is None:
        prefix = prefix_bits(fps.count(), radius)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        left = pdf["left"].to_numpy(np.int64)
        found = [np.stack(p, axis=1) for p in meetings(fp, left, 64 - prefix, most=2 * radius)]
        if not found:
            return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
        pair = np.unique(np.concatenate(found), axis=0)
        nodes, place = np.unique(pair, return_inverse=True)
        place = place.reshape(pair.shape)
        pair = pair[forest(place[:, 0], place[:, 1], len(nodes))]
        return pd.DataFrame({"a": pair[:, 0].view(np.int64), "b": pair[:, 1].view(np.int64)})

    return reach(fps, prefix, radius).groupBy("place").applyInPandas(meet, "a bigint, b bigint").distinct()


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE,
    radius: int = RADIUS,
    prefix: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Texts are lower-cased in A-Z and split at ASCII white space; fewer words than a shingle make one shingle, none
    make fingerprint zero, which links like any other. Null text counts as empty. Rows with equal fingerprints are
    one class and travel once; links are between classes, so copies are never paired. Fingerprints link at
    2 * radius or fewer differing bits, and components follow links of any length. Null ids take part and are named by
    the smallest id in reach, null if there is none. An empty table gives no rows. Other columns are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    edges = materialize(links(classes.select("fp"), radius, prefix), "simhash-links")
    member = connected_components(edges)
    # Components of fingerprints, then the smallest document of each.
    named = classes.join(member, classes["fp"] == member["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(smallest, "component").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(labels, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents with one of each group of near copies, all columns kept: the smallest doc_id of the group.

    Near are documents whose sets of `words`-word shingles have a Jaccard similarity of `threshold` or more, found by
    bands of minimum hashes of these shingles and then compared exactly, so a clean document is never dropped for a
    chance likeness. Rows without id stay; rows that share a doc_id stay apart if their texts do.
    """
    from .near_choice import near_copies
    from .selection import ROW, keep_numbered, with_rows

    rows = with_rows(docs)
    return keep_numbered(rows, near_copies(rows, ROW, id_col, text_col, words, threshold))
