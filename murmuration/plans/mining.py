"""Sequences, isotonic fits, communities, walks, factors, topics, outlier forests and a growing tree, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community as cm
from ..operators import decomposition as dc
from ..operators import hidden as hm
from ..operators import isolation as iso
from ..operators import isotonic as it
from ..operators import quantizer as qz
from ..operators import rules as rl
from ..operators import sequences as sq
from ..operators import text as tx
from ..operators import topics as tp
from ..session import table
from ..store import materialize
from ..streaming import hoeffding as hf
from . import relational as rel
from .inputs import SCORED, Catalog, scored
from .streams import ev

C = Catalog()

C.add("prefixspan", lambda s, d: sq.prefixspan(ev(s, d), "user_id", "event_type", ["ts", "event_id"], 0.3, 3).select(F.array_join("items", ">").alias("items"), "n", "support"),
      """WITH e AS MATERIALIZED (SELECT user_id AS s, event_type AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
      f AS MATERIALIZED (SELECT s, x, min(i) AS i, max(i) AS j FROM e GROUP BY ALL), t AS (SELECT count(DISTINCT s) AS n FROM e),
      p AS (SELECT x AS items, s FROM f UNION ALL SELECT a.x || '>' || b.x, a.s FROM f a JOIN f b ON a.s = b.s AND a.i < b.j
      UNION ALL SELECT DISTINCT a.x || '>' || e.x || '>' || b.x, a.s FROM f a JOIN f b ON a.s = b.s JOIN e ON e.s = a.s AND e.i > a.i AND e.i < b.j)
      SELECT items, count(*) AS n, count(*) / max(t.n) AS support FROM p, t GROUP BY items HAVING count(*) >= ceil(0.3 * max(t.n) - 1e-9)""", "support", "n")


def _isotonic_sql(source: str) -> str:
    """The greatest of the least means over intervals around each place."""
    return f"""WITH g AS MATERIALIZED (SELECT x, sum(y) AS t, count(*)::DOUBLE AS w, row_number() OVER (ORDER BY x) AS i FROM {source} GROUP BY x),
      c AS MATERIALIZED (SELECT i, x, sum(t) OVER (ORDER BY i) AS t, sum(w) OVER (ORDER BY i) AS w, t AS own_t, w AS own_w FROM g),
      m AS MATERIALIZED (SELECT a.i AS a, b.i AS b, (b.t - a.t + a.own_t) / (b.w - a.w + a.own_w) AS mean FROM c a JOIN c b ON a.i <= b.i)
      SELECT x, max(least) AS fitted FROM (SELECT c.x, m.a, min(m.mean) AS least FROM c JOIN m ON m.a <= c.i AND m.b >= c.i GROUP BY 1, 2) GROUP BY x"""


def _isotonic(s, d):
    rows = scored(s, d).select(F.col("q").alias("x"), F.col("disc").alias("y"))
    return it.isotonic_predict(rows.select("x").distinct(), "x", it.isotonic_blocks(rows, "x", "y"))


C.add("isotonic_regression", _isotonic, _isotonic_sql(f"(SELECT q AS x, disc AS y FROM {SCORED})"), "fitted", digits=9)


def _calibrated(s, d):
    rows = scored(s, d).select("label", (F.floor(F.col("score") * 100) / 100).alias("x"), "y")
    return it.isotonic_predict(rows.select("x").distinct(), "x", it.isotonic_blocks(rows, "x", "y"))


C.add("isotonic_calibration", _calibrated, _isotonic_sql(f"(SELECT floor(score * 100) / 100 AS x, y FROM {SCORED})"), "x fitted", digits=8)


def _communities(s, d):
    labels, _ = cm.louvain(rel.und(s, d))
    return labels


C.add("louvain", _communities)
C.add("random_walks", lambda s, d: cm.random_walks(rel.und(s, d), 3).select("start", "walk", "step", "node").withColumns({c: F.col(c).cast("long") for c in ("walk", "step")}),
      f"""WITH RECURSIVE u AS MATERIALIZED (SELECT src, dst FROM {rel._U}), c AS MATERIALIZED (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) / count(*) OVER (PARTITION BY src) AS low, row_number() OVER (PARTITION BY src ORDER BY dst) / count(*) OVER (PARTITION BY src) AS high FROM u),
      w AS (SELECT DISTINCT src AS start, CAST(0 AS BIGINT) AS walk, CAST(0 AS BIGINT) AS step, src AS node FROM u
      UNION ALL SELECT start, walk, step + 1, dst FROM (SELECT *, CAST('0x' || substr(md5('walk:' || start || ':' || walk || ':' || (step + 1)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw FROM w WHERE step < 3) w JOIN c ON c.src = w.node AND draw >= low AND draw < high)
      SELECT start, walk, step, node FROM w""", "", "walk step")


def _pairs(s, d):
    """Suppliers by return flag: a long matrix of two columns, whose singular values have a closed form."""
    rows = table(s, d, "lineitem").where("l_returnflag IN ('A', 'R')")
    return rows.groupBy(F.col("l_suppkey").alias("row"), F.col("l_returnflag").alias("col")).agg(F.sum("l_quantity").alias("value"))


_PAIRS = "(SELECT l_suppkey AS r, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS a, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1)"
_SQUARES = f"(SELECT sum(a * a) AS x, sum(b * b) AS y, sum(a * b) AS z FROM {_PAIRS})"


def _singular(s, d):
    _, values, _ = dc.truncated_svd(_pairs(s, d), 2)
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, value double")


C.add("truncated_svd", _singular, f"SELECT 0 AS i, sqrt((x + y) / 2 + sqrt((x - y) * (x - y) / 4 + z * z)) AS value FROM {_SQUARES} UNION ALL SELECT 1, sqrt((x + y) / 2 - sqrt((x - y) * (x - y) / 4 + z * z)) FROM {_SQUARES}", "value", "i", digits=4)


def _one_factor(s, d):
    _, _, errors = dc.nmf(_pairs(s, d), 1, 8)
    return s.createDataFrame([(float(errors[-1]),)], "error double")


C.add("nmf", _one_factor, f"SELECT sqrt((x + y) / 2 - sqrt((x - y) * (x - y) / 4 + z * z)) AS error FROM {_SQUARES}", "error", digits=3)


def _lsa(s, d):
    left, _, _ = dc.latent_semantic_analysis(tx.tfidf(table(s, d, "documents").where("text is not null"), "doc_id", "text", min_df=5), "doc_id", 4, rounds=4)
    return left.select("doc_id", *[F.col("vector")[j].alias(f"v{j}") for j in range(4)])


C.add("latent_semantic_analysis", _lsa)


def _topics(s, d):
    counts = materialize(tx.count_terms(table(s, d, "documents").where("text is not null"), "doc_id", "text", min_df=5), "terms")
    topics, _, _ = tp.latent_dirichlet(counts, "doc_id", 4, rounds=6)
    return tx.topic_coherence(tp.top_terms(topics), counts.select("doc_id", "term"), "doc_id")


C.add("latent_dirichlet", _topics)
_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _forest(s, d):
    li = table(s, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return iso.isolation_scores(li, iso.fit_isolation_forest(li, "id", _FEATURES, 50)).select("id", "score")


C.add("isolation_forest", _forest)


def _half_spaces(s, d):
    e = ev(s, d).withColumn("hour", F.hour("ts").cast("double"))
    model = iso.HalfSpaces(("value", "hour"), (0.0, 0.0), (200.0, 24.0))
    days = [e.where(F.pmod(F.dayofyear("ts"), F.lit(2)) == k) for k in (0, 1)]
    return iso.half_space_stream(days, model)[1].select("event_id", "mass")


C.add("half_space_trees", _half_spaces)


def _hoeffding(s, d):
    rows = scored(s, d).select("id", "q", "disc", F.when((F.col("q") > 25) & (F.col("disc") > 0.05), "high").otherwise("low").alias("c"))
    tree = hf.HoeffdingTree(["q", "disc"], [(0.0, 50.0), (0.0, 0.1)], "c", ["high", "low"])
    hf.grow_from_table(tree, rows, ["id"], max(1, rows.count() // 8 + 1))
    return tree.predict(rows).groupBy("c", "predicted").agg(F.count("*").alias("n"))


C.add("hoeffding_tree", _hoeffding)


def _states(s, d):
    seqs = hm.sequences(ev(s, d), "user_id", "event_type", ["ts", "event_id"])
    model, _ = hm.fit_hidden(seqs, 2, 8)
    return hm.decode_hidden(seqs, model).select("user_id", F.size("states").cast("long").alias("n"), "likelihood")


C.add("hidden_markov", _states)


def _rules(s, d):
    rows = scored(s, d).select("q", "disc", "tax", F.when((F.col("q") > 30) & (F.col("disc") > 0.06), 10.0).otherwise(0.0).alias("y"))
    return rl.fit_rules(rows, ["q", "disc", "tax"], "y", trees=4).table(s)


C.add("rule_fit", _rules)


def _quantized(s, d):
    base = table(s, d, "embeddings")
    model = qz.fit_quantizer(base, "vec_id", "embedding", 16, 8, 64)
    coded = qz.encode(base, model, "vec_id", "embedding")
    return qz.quantized_search(base.where("vec_id % 20 = 0"), base, coded, model, "vec_id", "embedding", 5, 4, 60)


C.add("product_quantizer_search", _quantized)
