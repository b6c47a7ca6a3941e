"""Queries of neighbour models, hashed search, similar sets, counters, recommenders and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nearest as ne
from ..operators import recommend as rec
from ..operators import resample as rs
from ..operators.learners import knn
from ..session import table
from ..store import materialize
from .inputs import Catalog

C = Catalog()

_D = "list_sum([power(x[1]::DOUBLE - x[2]::DOUBLE, 2) FOR x IN list_zip(a.embedding, b.embedding)])"
_NN = f"""(SELECT q, id, label, distance, rank FROM (SELECT a.vec_id AS q, b.vec_id AS id, b.label, sqrt({_D}) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt({_D}), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5)"""


def vectors(s, d):
    return table(s, d, "embeddings")


def asked(s, d):
    return vectors(s, d).where("vec_id % 20 = 0")


C.add("knn_classifier", lambda s, d: ne.knn_classify(asked(s, d), vectors(s, d), "vec_id", "embedding", "label"),
      f"SELECT q, arg_min(label, (-n, label)) AS predicted FROM (SELECT q, label, count(*) AS n FROM {_NN} GROUP BY 1, 2) GROUP BY 1")
C.add("knn_regressor", lambda s, d: ne.knn_regress(asked(s, d), vectors(s, d), "vec_id", "embedding", "label", weights="distance"),
      f"SELECT q, sum(label / greatest(distance, 1e-12)) / sum(1 / greatest(distance, 1e-12)) AS predicted FROM {_NN} GROUP BY 1", "predicted")
C.add("lsh_search", lambda s, d: ne.recall(ne.lsh_search(asked(s, d), vectors(s, d), "vec_id", "embedding", 64, 3, 48, 4), knn(asked(s, d), vectors(s, d), "vec_id", "embedding", 3)).select((F.col("recall") >= 0.9).alias("enough")), "SELECT true AS enough")


def _centres(s, d):
    from ..operators.learners import seed_vectors

    return seed_vectors(vectors(s, d), "embedding", 8)


C.add("inverted_file_search", lambda s, d: ne.recall(ne.cell_search(asked(s, d), vectors(s, d), _centres(s, d), "vec_id", "embedding", 3, 8), knn(asked(s, d), vectors(s, d), "vec_id", "embedding", 3)), "SELECT 1.0::DOUBLE AS recall", "recall")
_SETS = "(SELECT u AS id, s FROM (SELECT o_custkey AS u, list_sort(list_distinct(list(p_brand))) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1))"


def _sets(s, d):
    j = table(s, d, "orders").join(table(s, d, "lineitem"), F.expr("l_orderkey = o_orderkey")).join(table(s, d, "part"), F.expr("p_partkey = l_partkey"))
    return j.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("p_brand").alias("items"))


def _similar(s, d):
    sets = materialize(_sets(s, d), "sets")
    return ne.similar_sets(sets, "id", "items", 0.8, 48, 3).unionByName(ne.copies(sets, "id", "items"))


C.add("minhash_lsh", _similar,
      f"""WITH g AS MATERIALIZED (SELECT * FROM {_SETS}), k AS (SELECT s, min(id) AS id FROM g GROUP BY s) SELECT k.id AS a, g.id AS b, 1.0::DOUBLE AS jaccard FROM g JOIN k USING (s) WHERE g.id <> k.id UNION ALL SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS jaccard FROM k a JOIN k b ON a.id < b.id
      WHERE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.8""", "jaccard")
C.add("count_min_sketch", lambda s, d: (lambda e: ne.count_min_estimate(ne.count_min(e, "user_id", 4096, 5), e.select("user_id").distinct(), "user_id", 4096, 5))(table(s, d, "events")).join(table(s, d, "events").groupBy("user_id").count(), "user_id").agg(F.min((F.col("estimate") >= F.col("count")).cast("int")).alias("never_below"), (F.avg((F.col("estimate") == F.col("count")).cast("int")) > 0.9).alias("mostly_exact")),
      "SELECT CAST(1 AS INTEGER) AS never_below, true AS mostly_exact")
_R = "(SELECT o_custkey AS u, l_partkey % 50 AS i, avg(l_quantity) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def ratings(s, d):
    return table(s, d, "orders").join(table(s, d, "lineitem"), F.expr("o_orderkey = l_orderkey")).groupBy(F.col("o_custkey").alias("u"), (F.col("l_partkey") % 50).alias("i")).agg(F.avg("l_quantity").alias("r"))


_SIM = f"""(WITH c AS MATERIALIZED (SELECT u, i, r - avg(r) OVER (PARTITION BY i) AS c FROM {_R}), n AS (SELECT i, sqrt(sum(c * c)) AS s FROM c GROUP BY 1)
  SELECT g.i, g.j, d / (x.s * y.s) AS sim FROM (SELECT a.i AS i, b.i AS j, sum(a.c * b.c) AS d FROM c a JOIN c b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2) g JOIN n x ON x.i = g.i JOIN n y ON y.i = g.j WHERE x.s > 0 AND y.s > 0)"""
C.add("item_similarity", lambda s, d: rec.item_similarity(ratings(s, d), "u", "i", "r"), f"SELECT * FROM {_SIM}", "sim")
C.add("item_based_cf", lambda s, d: rec.item_predict(rec.item_similarity(ratings(s, d), "u", "i", "r"), ratings(s, d), "u", "i", "r", 1000).groupBy("i").agg(F.avg("predicted").alias("mean"), F.count("*").alias("n")),
      f"""WITH r AS MATERIALIZED (SELECT * FROM {_R}), s AS MATERIALIZED (SELECT * FROM {_SIM}), p AS (SELECT u, s.i, sum(sim * r) / sum(abs(sim)) AS predicted FROM r JOIN s ON s.j = r.i GROUP BY 1, 2)
      SELECT i, avg(predicted) AS mean, count(*) AS n FROM p ANTI JOIN r USING (u, i) GROUP BY 1""", "mean", digits=4)
C.add("popularity", lambda s, d: rec.popularity(ratings(s, d), "i", "r"), f"SELECT i, (sum(r) + 10 * (SELECT avg(r) FROM {_R})) / (count(*) + 10) AS score FROM {_R} GROUP BY 1", "score")


_DRAW = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


def _als(s, d):
    r = ratings(s, d)
    users, items, mean = rec.alternating_least_squares(r, "u", "i", "r", 1, 2, 0.1)
    return rec.factor_predict(r, users, items, mean, "u", "i").groupBy("i").agg(F.avg("predicted").alias("mean"), F.avg((F.col("r") - F.col("predicted")) ** 2).alias("mse"))


def _als_sql(rounds):
    steps = [f"g AS MATERIALIZED (SELECT u, i, r, r - avg(r) OVER () AS c, avg(r) OVER () AS m FROM {_R})", f"i0 AS MATERIALIZED (SELECT DISTINCT i AS k, {_DRAW.format("'3:0:' || i")} - 0.5 AS f FROM g)"]
    for n in range(rounds):
        steps.append(f"u{n + 1} AS MATERIALIZED (SELECT u AS k, sum(c * f) / (sum(f * f) + 0.1 * count(*)) AS f FROM g JOIN i{n} x ON x.k = g.i GROUP BY u)")
        steps.append(f"i{n + 1} AS MATERIALIZED (SELECT i AS k, sum(c * f) / (sum(f * f) + 0.1 * count(*)) AS f FROM g JOIN u{n + 1} x ON x.k = g.u GROUP BY i)")
    return f"WITH {', '.join(steps)} SELECT i, avg(m + x.f * y.f) AS mean, avg(power(r - m - x.f * y.f, 2)) AS mse FROM g JOIN u{rounds} x ON x.k = g.u JOIN i{rounds} y ON y.k = g.i GROUP BY i"


C.add("alternating_least_squares", _als, _als_sql(2), "mean mse")


def _few(s, d):
    return table(s, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("c"), (F.col("s_acctbal") / 1000).alias("a"), F.col("s_nationkey").cast("double").alias("b"))


_SM = "(SELECT s_suppkey AS id, s_acctbal / 1000 AS a, s_nationkey::DOUBLE AS b FROM supplier WHERE s_nationkey % 3 = 1)"
C.add("smote", lambda s, d: rs.smote(_few(s, d), "s_suppkey", "c", 1, ["a", "b"], 1, 1).select("s_suppkey", "neighbour", "a", "b"),
      f"SELECT id AS s_suppkey, n AS neighbour, a + s * (na - a) AS a, b + s * (nb - b) AS b FROM (SELECT x.id, x.a, x.b, y.a AS na, y.b AS nb, {_DRAW.format("'0:share:' || x.id || ':1'")} AS s, y.id AS n, row_number() OVER (PARTITION BY x.id ORDER BY power(x.a - y.a, 2) + power(x.b - y.b, 2), y.id) AS k FROM {_SM} x JOIN {_SM} y ON x.id <> y.id) WHERE k = 1", "a b")
_GAP = "(SELECT p_partkey, p_size::DOUBLE AS z, p_retailprice AS p, CASE WHEN p_partkey % 25 = 0 THEN NULL ELSE p_partkey % 7 + p_size / 10.0 END AS t FROM part)"


def _gaps(s, d):
    return table(s, d, "part").selectExpr("p_partkey", "cast(p_size as double) AS z", "p_retailprice AS p", "CASE WHEN p_partkey % 25 = 0 THEN NULL ELSE p_partkey % 7 + p_size / 10.0D END AS t")


C.add("knn_imputer", lambda s, d: rs.knn_impute(_gaps(s, d), "p_partkey", "t", ["z", "p"], 4),
      f"SELECT q AS p_partkey, avg(t) AS imputed FROM (SELECT a.p_partkey AS q, b.t, row_number() OVER (PARTITION BY a.p_partkey ORDER BY sqrt(power(a.z - b.z, 2) + power(a.p - b.p, 2)), b.p_partkey) AS k FROM {_GAP} a JOIN {_GAP} b ON a.t IS NULL AND b.t IS NOT NULL) WHERE k <= 4 GROUP BY 1", "imputed")
C.add("iterative_imputer", lambda s, d: rs.iterative_impute(_gaps(s, d).select("p_partkey", "z", "t"), ["z", "t"], 2).select("p_partkey", "t"),
      f"SELECT p_partkey, coalesce(t, (SELECT regr_intercept(t, z) FROM {_GAP}) + z * (SELECT regr_slope(t, z) FROM {_GAP})) AS t FROM {_GAP}", "t")
C.add("tomek_links", lambda s, d: rs.tomek_links(_few(s, d).withColumn("v", F.array("a", "b")), "s_suppkey", "c", "v"),
      """WITH v AS (SELECT s_suppkey AS id, s_nationkey % 3 AS c, s_acctbal / 1000 AS a, s_nationkey::DOUBLE AS b FROM supplier), n AS (SELECT q, id FROM (SELECT x.id AS q, y.id, row_number() OVER (PARTITION BY x.id ORDER BY sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2)), y.id) AS k FROM v x JOIN v y ON x.id <> y.id) WHERE k = 1)
      SELECT m.q AS a, m.id AS b FROM n m JOIN n o ON m.q = o.id AND m.id = o.q JOIN v x ON x.id = m.q JOIN v y ON y.id = m.id WHERE m.q < m.id AND x.c <> y.c""")
C.add("out_of_bag", lambda s, d: rs.out_of_bag(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 4).withColumn("bag", F.col("bag").cast("long")),
      f"SELECT o_orderkey, bag FROM orders, (SELECT unnest(range(4)) AS bag) WHERE {_DRAW.format("'0:' || bag || ':' || o_orderkey")} <= 0.36787944117144233")
