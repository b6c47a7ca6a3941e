"""Queries of growing sums, spectra, vertical itemsets, hazards, importance, centralities and made-up tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compose as co
from ..operators import columns as col
from ..operators import decide as dec
from ..operators import graph as gr
from ..operators import incremental as inc
from ..operators import patterns as pt
from ..operators import series as ts
from ..operators import signal as sg
from ..session import table
from ..sources import generators as gen
from . import relational as rel
from .inputs import SCORED, Catalog, scored
from .textual import _SV, ev, surv

C = Catalog()


def _halves(s, d, by=None):
    df = scored(s, d).select("id", "label", "q", "disc")
    state = None
    for k in (0, 1, 2):
        state = inc.grow(state, inc.sums(df.where(F.col("id") % 3 == k), ["q", "disc"], by), by)
    return state


C.add("incremental_scaler", lambda s, d: inc.scaler_table(_halves(s, d), ["q", "disc"]), f"SELECT 'q' AS feature, avg(q) AS mean, stddev_pop(q) AS sd FROM {SCORED} UNION ALL SELECT 'disc', avg(disc), stddev_pop(disc) FROM {SCORED}", "mean sd", digits=9)
C.add("incremental_centroids", lambda s, d: inc.nearest_means(_halves(s, d, "label"), "label", ["q", "disc"]), f"SELECT label, avg(q) AS q, avg(disc) AS disc FROM {SCORED} GROUP BY 1", "q disc")
C.add("incremental_naive_bayes", lambda s, d: scored(s, d).select("q", "disc").distinct().withColumn("predicted", inc.naive_bayes(_halves(s, d, "label"), "label", ["q", "disc"])),
      f"""WITH t AS (SELECT label, count(*) AS n, avg(q) AS mq, var_pop(q) AS vq, avg(disc) AS md, var_pop(disc) AS vd FROM {SCORED} GROUP BY 1), f AS (SELECT 1e-9 * greatest(var_pop(q), var_pop(disc)) AS f, count(*) AS total FROM {SCORED}),
      s AS (SELECT x.q, x.disc, label, ln(n / total) - power(x.q - mq, 2) / (2 * (vq + f)) - 0.5 * ln(2 * pi() * (vq + f)) - power(x.disc - md, 2) / (2 * (vd + f)) - 0.5 * ln(2 * pi() * (vd + f)) AS s FROM (SELECT DISTINCT q, disc FROM {SCORED}) x, t, f)
      SELECT q, disc, arg_max(label, s) AS predicted FROM s GROUP BY 1, 2""")
C.add("incremental_pca", lambda s, d: inc.components(_halves(s, d), ["q", "disc"], 1).where("feature = 'q'").select("variance"),
      f"SELECT (x + y) / 2 + sqrt((x - y) * (x - y) / 4 + z * z) AS variance FROM (SELECT var_samp(q) AS x, var_samp(disc) AS y, covar_samp(q, disc) AS z FROM {SCORED})", "variance", digits=5)


def _mini(s, d):
    e = table(s, d, "events").select("event_id", "value")
    found = inc.mini_batch_k_means([e.where(F.col("event_id") % 2 == k) for k in (0, 1)], ["value"], [[10.0], [90.0]])
    return s.createDataFrame([(i, float(p[0])) for i, p in enumerate(found)], "cluster long, centre double")


C.add("mini_batch_kmeans", _mini,
      """WITH a AS (SELECT CASE WHEN abs(value - 10) <= abs(value - 90) THEN 0 ELSE 1 END AS c, value FROM events WHERE event_id % 2 = 0), p AS (SELECT avg(value) FILTER (c = 0) AS x, avg(value) FILTER (c = 1) AS y, count(*) FILTER (c = 0) AS nx, count(*) FILTER (c = 1) AS ny FROM a),
      b AS (SELECT CASE WHEN abs(value - x) <= abs(value - y) THEN 0 ELSE 1 END AS c, value FROM events, p WHERE event_id % 2 = 1), q AS (SELECT sum(value) FILTER (c = 0) AS sx, sum(value) FILTER (c = 1) AS sy, count(*) FILTER (c = 0) AS mx, count(*) FILTER (c = 1) AS my FROM b)
      SELECT 0 AS cluster, (x * nx + sx) / (nx + mx) AS centre FROM p, q UNION ALL SELECT 1, (y * ny + sy) / (ny + my) FROM p, q""", "centre", "cluster")
C.add("periodogram", lambda s, d: sg.periodogram(ev(s, d), "value", ["ts", "event_id"], ["event_type"], [0, 1, 5]).withColumn("k", F.col("k").cast("long")),
      """WITH n AS (SELECT event_type, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
      SELECT event_type, k, (power(sum(value * cos(2 * pi() * i * k / n)), 2) + power(sum(value * sin(2 * pi() * i * k / n)), 2)) / max(n) AS power FROM n, (SELECT unnest([0, 1, 5]) AS k) GROUP BY 1, 2""", "power", "k", digits=4)
C.add("haar_wavelet", lambda s, d: sg.haar(ev(s, d), "value", ["ts", "event_id"], ["user_id"], 1).select("user_id", F.col("at").cast("long").alias("at"), "smooth", "detail"),
      """WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
      SELECT user_id, x.i // 2 AS "at", (x.value + y.value) / sqrt(2) AS smooth, (x.value - y.value) / sqrt(2) AS detail FROM n x JOIN n y USING (user_id) WHERE x.i % 2 = 0 AND y.i = x.i + 1""", "smooth detail", '"at"')


def _curves(s, d):
    g = table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x"))
    a = g.select(F.col("o_custkey").alias("a"), F.transform(F.slice("x", 1, 1000), lambda e: e["o_totalprice"] / 1000).alias("va"))
    b = g.select((F.col("o_custkey") - 1).alias("a"), F.transform("x", lambda e: e["o_totalprice"] / 1000).alias("vb"))
    return a.join(b, "a")


C.add("dynamic_time_warping", lambda s, d: _curves(s, d).select("a", sg.warped_distance(F.col("va"), F.col("vb")).alias("distance")))
C.add("eclat", lambda s, d: pt.eclat(rel.baskets(s, d), "items", "l_orderkey", 0.012, 3).select(F.array_join("items", ",").alias("items"), "n", "support"),
      f"SELECT array_to_string(items, ',') AS items, n, support FROM {rel._SETS}", "support", "n")
C.add("cox_hazards", lambda s, d: ts.cox(surv(s, d).withColumn("z", F.col("risk") / 50), "dur", "ev", ["z"], 5),
      "WITH d AS MATERIALIZED (SELECT dur AS t, ev AS e, risk / 50 AS z FROM " + _SV + "), b0 AS (SELECT 0.0::DOUBLE AS b)" + "".join(
          f""", r{i} AS (SELECT any_value(b) AS b, t, sum(e) AS k, sum(e * z) AS x, sum(exp(b * z)) AS s0, sum(exp(b * z) * z) AS s1, sum(exp(b * z) * z * z) AS s2 FROM d, b{i} GROUP BY t),
          c{i} AS (SELECT b, k, x, sum(s0) OVER w AS r0, sum(s1) OVER w AS r1, sum(s2) OVER w AS r2 FROM r{i} WINDOW w AS (ORDER BY t DESC)), b{i + 1} AS (SELECT any_value(b) + sum(x - k * r1 / r0) / sum(k * (r2 / r0 - r1 * r1 / (r0 * r0))) AS b FROM c{i} WHERE k > 0)""" for i in range(5)) + " SELECT 'z' AS term, b AS coefficient FROM b5", "coefficient", digits=5)
C.add("katz_centrality", lambda s, d: gr.katz(rel.directed(s, d), 0.05, 1.0, 4),
      f"WITH e AS MATERIALIZED (SELECT * FROM {rel._E}), n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), x0 AS (SELECT node, 0.0::DOUBLE AS x FROM n)" + "".join(
          f", x{i + 1} AS MATERIALIZED (SELECT n.node, 1 + 0.05 * coalesce(sum(x), 0) AS x FROM n LEFT JOIN e ON e.dst = n.node LEFT JOIN x{i} p ON p.node = e.src GROUP BY 1)" for i in range(4)) + " SELECT node, x AS centrality FROM x4", "centrality")
C.add("permutation_importance", lambda s, d: dec.permutation_importance(table(s, d, "part").selectExpr("p_partkey AS id", "p_retailprice AS p", "cast(p_size as double) AS z", "p_retailprice + p_size * 3 AS y"), "id", ["p", "z"], "y", lambda: F.col("p") + F.col("z") * 2, co.SCORES["mae"]),
      """WITH a AS (SELECT p_retailprice AS p, p_size::DOUBLE AS z, p_retailprice + p_size * 3 AS y, row_number() OVER (ORDER BY p_partkey) AS i, row_number() OVER (ORDER BY md5('0:' || p_partkey), p_partkey) AS j FROM part), m AS (SELECT avg(abs(y - p - z * 2)) AS e FROM a)
      SELECT 'p' AS feature, (SELECT e FROM m) - avg(abs(x.y - w.p - x.z * 2)) AS drop FROM a x JOIN a w ON x.i = w.j UNION ALL SELECT 'z', (SELECT e FROM m) - avg(abs(x.y - x.p - w.z * 2)) FROM a x JOIN a w ON x.i = w.j""", "drop", digits=3)
C.add("row_guard", lambda s, d: col.check_table(table(s, d, "part"), ["p_size", "p_retailprice"]).agg(F.count("*").alias("n"), F.sum("p_size").alias("total")), "SELECT count(*) AS n, CAST(sum(p_size) AS DOUBLE) AS total FROM part", "total")
C.add("make_circles", lambda s, d: gen.make_circles(s, 1000).select("id", F.sqrt(F.col("x0") ** 2 + F.col("x1") ** 2).alias("radius"), F.col("label").cast("long").alias("label")),
      "SELECT unnest(range(1000)) AS id, CASE WHEN unnest(range(1000)) < 500 THEN 1.0 ELSE 0.8 END AS radius, CASE WHEN unnest(range(1000)) < 500 THEN 0 ELSE 1 END AS label", "radius", "label")
C.add("make_moons", lambda s, d: gen.make_moons(s, 1000).select("id", "x0", "x1", F.col("label").cast("long").alias("label")),
      """SELECT id, label, CASE WHEN label = 0 THEN cos(t) ELSE 1 - cos(t) END AS x0, CASE WHEN label = 0 THEN sin(t) ELSE 0.5 - sin(t) END AS x1 FROM (SELECT id, CASE WHEN id < 500 THEN 0 ELSE 1 END AS label, pi() * (id % 500) / 499 AS t FROM (SELECT unnest(range(1000)) AS id))""", "x0 x1", "label")
C.add("make_spiral", lambda s, d: gen.make_spiral(s, 1000, 2, 0.0).select("id", "x0", "x1"),
      "SELECT id, r * cos(4 * r + pi() * (id % 2)) AS x0, r * sin(4 * r + pi() * (id % 2)) AS x1 FROM (SELECT id, (id // 2) / 499 AS r FROM (SELECT unnest(range(1000)) AS id))", "x0 x1")


def _regression(s, d):
    df, b = gen.make_regression(s, 2000, 4, 2)
    y = F.col("x0") * b[0] + F.col("x1") * b[1]
    return df.agg((F.max(F.abs(F.col("y") - y)) < 1e-9).alias("linear"), (F.abs(F.avg("x2")) < 0.1).alias("centred"), (F.abs(F.stddev("x3") - 1) < 0.1).alias("spread"))


C.add("make_regression", _regression, "SELECT true AS linear, true AS centred, true AS spread")
C.add("make_blobs", lambda s, d: gen.make_blobs(s, 3000).groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), (F.abs(F.stddev("x0") - 1) < 0.1).alias("spread")), "SELECT unnest(range(3)) AS label, CAST(1000 AS BIGINT) AS n, true AS spread")
C.add("make_classification", lambda s, d: gen.make_classification(s, 2000, 6, 2, 2).groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), (F.abs(F.avg("x0") - F.when(F.first("label") == 1, 2.0).otherwise(-2.0)) < 0.2).alias("apart"), (F.abs(F.avg("x5")) < 0.2).alias("noise")), "SELECT unnest(range(2)) AS label, CAST(1000 AS BIGINT) AS n, true AS apart, true AS noise")
