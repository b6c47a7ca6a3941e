"""Communities by modularity, and random walks, over edge tables.

Edges are rows (src, dst) in both directions, as `graph.undirected` gives them, or (src, dst, w) with weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize, placed, release, sized
from .ordering import numbered, running

#: Parts that nodes are dealt to, at most: a part's nodes move at once.
MOST_PARTS = 16
#: Bytes of what travels with a step's job, 12 a node; links that a task looks at at a time.
STATE_BYTES, LINKS = 24 << 20, 1 << 19
#: Edges of one node up to which they stand in one list.
LIST = 1 << 16
_GAIN = 1e-12


def weighted_modularity(edges: DataFrame, labels: DataFrame, total: float | None = None) -> float:
    """Share of weight inside communities less what degrees alone would give; edges (src, dst, w), labels (node, label).

    `total` is the sum of the weights, where it is known.
    """
    own, other = labels.toDF("src", "ls"), labels.toDF("dst", "ld")
    m = edges.join(own, "src").join(other, "dst")
    per = m.groupBy("ls").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = total or edges.agg(F.sum("w")).first()[0] or 1.0
    return per.agg(F.sum(F.col("inside") / total - F.pow(F.col("k") / total, 2))).first()[0] or 0.0


def _moved(edges: DataFrame, state: DataFrame, m2: float, parts: int, turn: int, least: float = _GAIN) -> DataFrame:
    """(node, label, k, changed, from, gain) after the nodes of one part have moved to the neighbouring community of greatest gain.

    A node moves if that alone raises the modularity by more than `least`.
    """
    sizes = state.groupBy("label").agg(F.sum("k").alias("total"))
    known = state.select("node", "label", "k").join(sizes, "label")
    there = known.select(F.col("node").alias("dst"), F.col("label").alias("to"), "total")
    # Whose turn it is shows in the edge; edges stand by their other end, so that only links travel, once, to their node.
    turned = edges.where("src <> dst").where(F.pmod(F.xxhash64("src"), F.lit(parts)) == turn % parts)
    links = turned.join(there, "dst").select("src", "to", "w", "total").repartition("src").groupBy("src", "to").agg(F.sum("w").alias("link"), F.max("total").alias("total"))
    told = links.join(known.select(F.col("node").alias("src"), "label", "k", F.col("total").alias("own")), "src")
    stays = F.col("to") == F.col("label")
    gain = F.col("link") - F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / m2
    # Staying is a choice, too, whether or not a neighbour is at home.
    alone = F.lit(0.0) - F.col("k") * (F.col("own") - F.col("k")) / m2
    best = told.groupBy("src").agg(F.max_by("to", F.struct(gain, (-F.col("to")).alias("t"))).alias("best"), F.max(gain).alias("gain"), F.coalesce(F.max(F.when(stays, gain)), F.max(alone)).alias("stay"))
    gone = best.where((F.col("gain") > F.col("stay") + least * m2 / 2) & F.col("best").isNotNull()).select(F.col("src").alias("node"), "best", (F.col("gain") - F.col("stay")).alias("gain"))
    return state.join(gone, "node", "left").select("node", F.coalesce("best", "label").alias("label"), "k", F.col("best").isNotNull().alias("changed"), F.col("label").alias("from"), "gain")


def _reached(edges: DataFrame, state: DataFrame, m2: float) -> float:
    """The modularity of a state, whose degrees are known: only the weight inside communities is read from the edges."""
    own, other = state.select(F.col("node").alias("src"), F.col("label").alias("ls")), state.select(F.col("node").alias("dst"), F.col("label").alias("ld"))
    inside = edges.join(other, "dst").join(own, "src").agg(F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w"))).alias("inside"))
    spread = state.groupBy("label").agg(F.sum("k").alias("k")).agg(F.sum(F.pow(F.col("k") / m2, 2)).alias("spread"))
    r = inside.crossJoin(spread).first()
    return (r.inside or 0.0) / m2 - (r.spread or 0.0)


def _by_steps(edges: DataFrame, m2: float, most_parts: int, least: float, reached: list[float]) -> DataFrame | None:
    """(node, label) where no node gains by moving any more, by joins; None if none has moved."""
    state = materialize(edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).select("node", F.col("node").alias("label"), "k"), "state")
    parts, turn, still, any_moved = 2, 0, 0, False
    while still < parts:
        after = materialize(_moved(edges, state, m2, parts, turn, least), "state")
        turn += 1
        movers = after.where("changed").count()
        if not movers:
            still += 1
            release(after.sparkSession, after)
            continue
        taken, q = after, _reached(edges, after, m2)
        share = 1
        if q <= reached[-1] + least:
            parts, still = min(parts * 2, most_parts), 0
        while q <= reached[-1] + least and share < 2 * movers:
            # Fewer of them go, at last the one that gains most.
            share *= 2
            if share < movers:
                goes = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(share)) == 0
            else:
                share = 2 * movers
                goes = F.col("node") == after.where("changed").orderBy(F.desc("gain"), "node").first().node
            taken = after.select("node", F.when(F.coalesce(F.col("changed") & goes, F.lit(False)), F.col("label")).otherwise(F.col("from")).alias("label"), "k")
            q = _reached(edges, taken, m2)
        if q <= reached[-1] + least:
            still += 1
            continue
        reached.append(q)
        before, state, still, any_moved = state, materialize(taken.select("node", "label", "k"), "state"), 0, True
        for x in (before, after):
            release(x.sparkSession, x)
    return state.select("node", "label") if any_moved else None


def _pieces(batch) -> Iterator[tuple]:
    """(nodes, place of each link's node, other ends, weights) of some rows of a batch at a time."""
    offsets = batch.column(1).offsets.to_numpy().astype(np.int64)
    other, w = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
    offsets = offsets - offsets[0]
    start, own = 0, batch.column(0).to_numpy()
    while start < len(own):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + LINKS, "right")) - 1)
        of = slice(offsets[start], offsets[end])
        yield own[start:end], np.repeat(np.arange(end - start), np.diff(offsets[start : end + 1])), other[of], w[of]
        start = end


def _movers(rows: DataFrame, label: np.ndarray, total: np.ndarray, m2: float, least: float) -> DataFrame:
    """(at, to, gain): every node that gains by moving alone, and where it gains most; ties go to the smaller label."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for own, place, other, w in _pieces(batch):
                k, mine = np.bincount(place, w, len(own)), label[own]
                far = other != own[place]
                place, to, w = place[far], label[other[far]], w[far]
                if not len(place):
                    continue
                order = np.lexsort((to, place))
                place, to = place[order], to[order]
                starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (to[1:] != to[:-1])]))
                link, place, to = np.add.reduceat(w[order], starts), place[starts], to[starts]
                stays = to == mine[place]
                gain = link - k[place] * (total[to] - np.where(stays, k[place], 0.0)) / m2
                stay = -k * (total[mine] - k) / m2
                stay[place[stays]] = gain[stays]
                order = np.lexsort((to, -gain, place))
                first = order[np.concatenate([[True], place[1:] != place[:-1]])]
                more = gain[first] - stay[place[first]]
                first, more = first[more > least * m2 / 2], more[more > least * m2 / 2]
                yield pa.RecordBatch.from_arrays([pa.array(own[place[first]]), pa.array(to[first]), pa.array(more)], names=["at", "to", "gain"])

    return rows.mapInArrow(run, "at int, to int, gain double")


def _insides(rows: DataFrame, label: np.ndarray, at: np.ndarray, to: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The weight inside communities after the first so many of some moves, for each of `sizes`, in one pass."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found, there, rank = np.zeros(len(sizes)), label.copy(), np.full(len(label), len(at), np.int32)
        there[at], rank[at] = to, np.arange(len(at))
        for batch in batches:
            for own, place, other, w in _pieces(batch):
                own = own[place]
                a, b, c, d, e, f = label[own], there[own], rank[own], label[other], there[other], rank[other]
                found += [w[np.where(c < n, b, a) == np.where(f < n, e, d)].sum() for n in sizes]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes), dtype=np.int32)), pa.array(found)], names=["i", "w"])

    sums = rows.mapInArrow(run, "i int, w double").groupBy("i").agg(F.sum("w").alias("w")).toArrow()
    out = np.zeros(len(sizes))
    out[sums.column("i").to_numpy()] = sums.column("w").to_numpy()
    return out


def _by_passes(edges: DataFrame, nodes: DataFrame, size: int, m2: float, least: float, reached: list[float]) -> DataFrame | None:
    """As `_by_steps`, where the labels and weights of `size` nodes travel: nodes' links stay where they are."""
    ends = materialize(numbered(nodes, ["node"]).select("node", F.col("_at").cast("int").alias("at")), "numbers")
    told = edges.join(sized(ends.toDF("src", "at"), size), "src").join(sized(ends.toDF("dst", "other"), size), "dst")
    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    listed = told.repartition(parts, "at").groupBy("at").agg(F.collect_list(F.struct("other", "w")).alias("e")).select("at", "e.other", "e.w")
    rows = materialize(listed, "links")
    degrees = rows.select("at", F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("k")).toArrow()
    k = np.zeros(size)
    k[degrees.column("at").to_numpy()] = degrees.column("k").to_numpy()
    label, total, draw = np.arange(size, dtype=np.int32), k.copy(), np.random.default_rng(size)
    any_moved = False
    while True:
        found = _movers(rows, label, total, m2, least).toArrow()
        n = found.num_rows
        if not n:
            break
        at, to, gain = (found.column(i).to_numpy() for i in range(3))
        # In an order by chance that depends on the nodes alone; whoever gains most comes first.
        order = np.argsort(at)
        order = order[draw.permutation(n)]
        best = int(np.argmax(gain[order]))
        order[[0, best]] = order[[best, 0]]
        at, to = at[order], to[order]
        sizes = sorted({max(1, n >> j) for j in range(n.bit_length())}, reverse=True)
        sums, q = [], _insides(rows, label, at, to, sizes) / m2
        for i, m in enumerate(sizes):
            after = total + np.bincount(to[:m], k[at[:m]], size) - np.bincount(label[at[:m]], k[at[:m]], size)
            q[i] -= ((after / m2) ** 2).sum()
            sums.append(after)
        i = int(np.argmax(q))
        if q[i] <= reached[-1] + least:
            break
        label[at[: sizes[i]]], total, any_moved = to[: sizes[i]], sums[i], True
        reached.append(float(q[i]))
    release(edges.sparkSession, rows)
    if not any_moved:
        return None
    import pyarrow as pa

    moved = edges.sparkSession.createDataFrame(pa.table({"at": pa.array(np.arange(size, dtype=np.int32)), "label": pa.array(label)}))
    return ends.join(sized(moved, size), "at").select("node", "label")


def louvain(edges: DataFrame, levels: int | None = None, most_parts: int = MOST_PARTS, least: float = _GAIN) -> tuple[DataFrame, list[float]]:
    """(node, label) by Louvain's method, and the modularity after every accepted step, which never falls.

    A step moves many nodes at once, each to the neighbouring community where it alone would gain most. Nodes that move
    together may spoil each other's gain: where a step does not raise the modularity by `least`, fewer of them go, at last
    only the one that gains most. So a level ends when no node is left that gains by moving. Then communities become nodes,
    whose weights are summed, until nothing changes, or for `levels` levels.

    Where the labels of all nodes fit STATE_BYTES, counted first, they travel to the nodes' links, and the best of several
    shares of a step's moves is taken; otherwise steps are joins, and the nodes of one part, chosen by hash, move at a time
    (2 parts, up to `most_parts` where steps fail). Labels are ids of nodes. Node ids have to be numbers; isolated nodes are
    in no edge and so in no community.
    """
    e = edges.withColumn("w", F.lit(1.0)) if "w" not in edges.columns else edges
    current = placed(e.select("src", "dst", F.col("w").cast("double").alias("w")), "dst", "graph")
    m2 = current.agg(F.sum("w")).first()[0]
    labels = materialize(current.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct(), "labels")
    if not m2:
        current.unpersist()
        return labels, []
    reached = [weighted_modularity(current, labels, m2)]
    level = 0
    while levels is None or level < levels:
        level += 1
        nodes = materialize(current.select(F.col("src").alias("node")).distinct(), "nodes")
        size = nodes.count()
        if 12 * size <= STATE_BYTES:
            state = _by_passes(current, nodes, size, m2, least, reached)
        else:
            state = _by_steps(current, m2, most_parts, least, reached)
        if state is None:
            break
        # A community goes by its least node, so labels stay ids.
        names = state.groupBy("label").agg(F.min("node").alias("name"))
        named = materialize(state.join(names, "label").select("node", F.col("name").alias("label")), "named")
        labels = materialize(labels.join(named.toDF("label", "to"), "label").select("node", F.col("to").alias("label")), "labels")
        own, other = named.toDF("src", "a"), named.toDF("dst", "b")
        before = current
        current = placed(before.join(own, "src").join(other, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "dst", "graph")
        before.unpersist()
    current.unpersist()
    return labels, reached


def random_walks(edges: DataFrame, length: int, per_node: int = 1, seed: str = "walk", salts: int = 64) -> DataFrame:
    """(walk, start, step, node): `per_node` walks from every node, each step to a random neighbour by weight.

    All walkers take a step by one join: a walker's draw in [0, 1) is a hash of its name and step, and neighbours own even
    intervals of [0, 1) by running weights. A node's neighbours stand in one list, dealt by the node once. If a node has more
    than LIST edges, walkers and edges meet by slices of the interval as well, so a hub is spread over `salts` slices.
    A walk ends where there is nowhere to go. Draws repeat from run to run.
    """
    e = edges.withColumn("w", F.lit(1.0)) if "w" not in edges.columns else edges
    e = materialize(e.select("src", "dst", F.col("w").cast("double").alias("w")), "edges")
    most = e.groupBy("src").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    sliced = most > LIST
    if sliced:
        upto = running(e, ["dst"], {"high": "w"}, ["src"], totals=True)
        spans = upto.select("src", "dst", ((F.col("high") - F.col("w")) / F.col("high_all")).alias("low"), (F.col("high") / F.col("high_all")).alias("high"))
        slices = F.sequence(F.floor(F.col("low") * salts), F.least(F.floor(F.col("high") * salts), F.lit(salts - 1).cast("long")))
        spans = materialize(spans.select("src", "dst", "low", "high", F.explode(slices).alias("slice")), "spans")
    else:
        own = Window.partitionBy("src")
        upto = e.withColumns({"high": F.coalesce(F.sum("w").over(own.orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)), "all": F.sum("w").over(own)})
        spans = placed(upto.groupBy("src").agg(F.collect_list(F.struct("dst", "high", "w")).alias("l"), F.first("all").alias("all")), "src", "spans")
    nodes = e.select(F.col("src").alias("start")).union(e.select("dst")).distinct()
    at = nodes.select("start", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk")).withColumn("node", F.col("start"))
    at = materialize(at.withColumn("step", F.lit(0)), "walkers")
    steps = [at]
    for k in range(1, length + 1):
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("start").cast("string"), F.col("walk").cast("string"), F.lit(str(k))))
        draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)
        walkers = steps[-1].withColumns({"draw": draw, "slice": F.floor(draw * salts)})
        if sliced:
            met = walkers.join(spans, (F.col("node") == F.col("src")) & (walkers["slice"] == spans["slice"]) & (F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high")))
        else:
            told = walkers.join(spans, F.col("node") == F.col("src")).select("start", "walk", "draw", "all", F.explode("l").alias("x"))
            met = told.where((F.col("draw") >= (F.col("x.high") - F.col("x.w")) / F.col("all")) & (F.col("draw") < F.col("x.high") / F.col("all"))).select("start", "walk", "x.dst")
        steps.append(materialize(met.select("start", "walk", F.col("dst").alias("node"), F.lit(k).alias("step")), "walkers"))
    spans.unpersist()
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def walk_vectors(walks: DataFrame, window: int = 5, rank: int = 16, seed: int = 5) -> DataFrame:
    """(node, vector): positive pointwise mutual information of nodes near each other on walks, by its leading factors."""
    from .decomposition import truncated_svd

    listed = walks.groupBy("start", "walk").agg(F.sort_array(F.collect_list(F.struct("step", "node"))).alias("p"))
    near = listed.select(F.posexplode("p").alias("i", "a"), "p").select("a.node", F.explode(F.slice("p", F.greatest(F.col("i") - window + 1, F.lit(1)), 2 * window + 1)).alias("b"), F.col("a.step").alias("i"))
    pairs = near.where((F.col("b.step") != F.col("i")) & (F.abs(F.col("b.step") - F.col("i")) <= window)).groupBy("node", F.col("b.node").alias("other")).agg(F.count("*").alias("n"))
    pairs = materialize(pairs, "near")
    of = pairs.groupBy("node").agg(F.sum("n").alias("k"))
    total = pairs.agg(F.sum("n")).first()[0] or 1
    pmi = F.ln(F.col("n") * float(total) / (F.col("k") * F.col("k2")))
    told = pairs.join(of, "node").join(of.toDF("other", "k2"), "other").select(F.col("node").alias("row"), F.col("other").alias("col"), pmi.alias("value")).where("value > 0")
    left, values, _ = truncated_svd(told, rank, seed=seed)
    scale = F.array(*[F.lit(float(v) ** 0.5) for v in values])
    return left.select(F.col("row").alias("node"), F.zip_with("vector", scale, lambda u, s: u * s).alias("vector"))
