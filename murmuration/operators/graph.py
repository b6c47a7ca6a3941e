"""Graphs as edge tables: link scores, ranks, communities and components.

Undirected graphs have both directions of each edge as rows (src, dst). Iterations exchange one row per node and keep
their state in checkpoints, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize


def cut(df: DataFrame) -> DataFrame:
    """A table whose lineage is cut, written to the shared folder: a lost executor takes nothing with it."""
    return materialize(df, "graph")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once, without loops."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def link_scores(edges: DataFrame) -> DataFrame:
    """a < b with a common neighbour: their number, Jaccard, Adamic-Adar, resource allocation, preferential attachment.

    A node's neighbours and their degrees go as two arrays to each of its neighbours; the pairs unfold and are summed
    where all of their first node stand, so no pair is a row of a shuffle.
    """
    d = cut(degrees(edges))
    known = edges.join(d.select(F.col("node").alias("dst"), F.col("degree").alias("kb")), "dst")
    listed = F.sort_array(F.collect_list(F.struct("dst", "kb")))
    around = known.groupBy("src").agg(listed.alias("l")).select("src", F.size("l").alias("k"), F.col("l.dst").alias("bs"), F.col("l.kb").alias("ks"))
    # The list is sorted and has `a` itself in it: what follows it is what is greater.
    sent = edges.select("src", F.col("dst").alias("a")).join(around, "src").withColumn("i", F.array_position("bs", F.col("a")).cast("int")).where("i < k")
    rest = lambda c: F.slice(c, F.col("i") + 1, F.col("k") - F.col("i"))
    own = sent.select("a", "k", F.element_at("ks", F.col("i")).alias("da"), rest("bs").alias("bs"), rest("ks").alias("ks")).repartition("a")
    wedges = own.select("a", "k", "da", F.explode(F.arrays_zip("bs", "ks")).alias("b")).select("a", "k", "da", F.col("b.bs").alias("b"), F.col("b.ks").alias("db"))
    per = wedges.groupBy("a", "b").agg(
        F.count("*").alias("common"), F.sum(F.when(F.col("k") > 1, 1 / F.ln("k")).otherwise(0.0)).alias("adamic_adar"), F.sum(1 / F.col("k")).alias("resource_allocation"),
        F.max("da").alias("da"), F.max("db").alias("db"),
    )
    return per.select(
        "a", "b", "common", "adamic_adar", "resource_allocation", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("jaccard"),
        (F.col("da") * F.col("db")).alias("preferential_attachment"),
    )


def normalized_adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, w): edges and self loops weighted by 1 / sqrt of both degrees (with the loop)."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    every = edges.select("src", "dst").union(loops)
    d = degrees(every)
    return every.join(d.select(F.col("node").alias("src"), F.col("degree").alias("x")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("y")), "dst").select("src", "dst", (1 / F.sqrt(F.col("x") * F.col("y"))).alias("w"))


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 200, tol: float = 1e-9) -> DataFrame:
    """(node, rank) summing to one; dead ends spread evenly.

    One action a round writes the new state, one small aggregate reads what dead ends hold and how far ranks moved.
    """
    e = cut(edges.select("src", "dst"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    state = cut(nodes.join(out, "node", "left"))
    n = state.count()
    rank = state.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    lost = rank.where("k is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    for _ in range(max_iter):
        sent = e.join(rank.where("k is not null"), e["src"] == rank["node"]).groupBy(F.col("dst").alias("_n")).agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
        share = damping * (F.coalesce("got", F.lit(0.0)) + lost / n) + (1 - damping) / n
        new = cut(rank.join(sent, F.col("node") == F.col("_n"), "left").select("node", "k", share.alias("rank"), F.col("rank").alias("old")))
        moved, lost = new.agg(F.coalesce(F.max(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("rank"))), F.lit(0.0))).first()
        rank = new.drop("old")
        if moved < tol:
            break
    total = F.broadcast(rank.agg(F.sum("rank").alias("_t")))
    return rank.crossJoin(total).select("node", (F.col("rank") / F.col("_t")).alias("rank"))


def katz(edges: DataFrame, alpha: float = 0.05, beta: float = 1.0, rounds: int = 20) -> DataFrame:
    """(node, centrality): beta plus alpha times the neighbours' centralities, over some rounds."""
    e = cut(edges.select("src", "dst"))
    state = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("x", F.lit(0.0)))
    for _ in range(rounds):
        got = e.join(state.select(F.col("node").alias("src"), "x"), "src").groupBy("dst").agg(F.sum("x").alias("g"))
        state = cut(state.join(got, F.col("node") == F.col("dst"), "left").select("node", (alpha * F.coalesce("g", F.lit(0.0)) + beta).alias("x")))
    return state.select("node", F.col("x").alias("centrality"))


def hits(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, hub, authority) after some rounds, each of length one."""
    e = cut(edges.select("src", "dst"))
    state = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumns({"hub": F.lit(1.0), "authority": F.lit(1.0)}))

    def step(state: DataFrame, read: str, write: str, there: str, here: str) -> DataFrame:
        got = e.join(state.select(F.col("node").alias(there), read), there).groupBy(here).agg(F.sum(read).alias("_g"))
        raw = cut(state.drop(write).join(got, F.col("node") == F.col(here), "left").select("node", read, F.coalesce("_g", F.lit(0.0)).alias(write)))
        size = raw.agg(F.sqrt(F.sum(F.col(write) ** 2))).first()[0] or 1.0
        return raw.withColumn(write, F.col(write) / size)

    for _ in range(rounds):
        state = step(state, "hub", "authority", "src", "dst")
        state = step(state, "authority", "hub", "dst", "src")
    return state.select("node", "hub", "authority")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label): all nodes at once take the label most common around them, the smallest of ties."""
    edges = cut(edges.select("src", "dst"))
    state = cut(edges.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = edges.join(state.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("b"))
        new = cut(state.join(best, F.col("node") == F.col("src")).select("node", (-F.col("b.m")).alias("label"), F.col("label").alias("old")))
        changed = new.where("label <> old").limit(1).count()
        state = new.drop("old")
        if not changed:
            break
    return state


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of edges inside communities, less what degrees alone would give."""
    l1 = labels.select(F.col("node").alias("src"), F.col("label").alias("ls"))
    l2 = labels.select(F.col("node").alias("dst"), F.col("label").alias("ld"))
    m = edges.join(l1, "src").join(l2, "dst")
    per = m.groupBy(F.col("ls").alias("label")).agg(F.count("*").alias("k"), F.sum((F.col("ls") == F.col("ld")).cast("long")).alias("inside"))
    total = F.broadcast(edges.agg(F.count("*").cast("double").alias("m2")))
    return per.crossJoin(total).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("k") / F.col("m2"), 2)).alias("modularity"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of degrees over the edges in both directions."""
    d = degrees(edges)
    j = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("x")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("y")), "dst")
    return j.agg(F.coalesce(F.nanvl(F.corr("x", "y"), F.lit(0.0)), F.lit(0.0)).alias("assortativity"))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles, clustering): closed wedges at each node, from edges ordered by degree."""
    d = degrees(edges)
    ranked = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("x")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("y")), "dst")
    up = ranked.where("x < y or (x = y and src < dst)").select("src", "dst")
    wedge = up.alias("p").join(up.alias("q"), F.col("p.src") == F.col("q.src")).where("p.dst <> q.dst").select(F.col("p.src").alias("a"), F.col("p.dst").alias("b"), F.col("q.dst").alias("c"))
    closed = wedge.join(up.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    per = closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    t = F.coalesce("t", F.lit(0))
    return d.join(per, "node", "left").select("node", t.alias("triangles"), F.when(F.col("degree") > 1, 2 * t / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, node, depth): breadth-first distances from some nodes, to any depth unless `max_depth` is given.

    Each round expands the last frontier only.
    """
    edges = cut(edges.select("src", "dst"))
    seen = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("depth")))
    front = seen
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select("source", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    return seen


def weisfeiler_lehman(edges: DataFrame, labels: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, round, label): labels refined by the hash of a node's label and its neighbours' sorted labels."""
    current = labels.select("node", F.col("label").cast("string").alias("label"))
    out = current.withColumn("round", F.lit(0))
    for i in range(1, rounds + 1):
        around = edges.join(current.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src").agg(F.sort_array(F.collect_list("label")).alias("around"))
        joined = current.join(around, F.col("node") == F.col("src"), "left")
        current = cut(joined.select("node", F.md5(F.concat_ws("|", "label", F.array_join("around", ","))).alias("label")))
        out = out.unionByName(current.withColumn("round", F.lit(i)))
    return out
