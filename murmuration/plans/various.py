"""Tensors, distances, active learning, calibration, generators and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as col
from ..operators import decide as dec
from ..operators import preprocessing as pre
from ..operators import tensors as tn
from ..session import table
from .inputs import SCORED, Catalog, scored

C = Catalog()
_T = "(SELECT n_regionkey AS i, n_nationkey % 4 AS j, n_nationkey % 3 AS k, sum(n_nationkey * 1.0::DOUBLE) AS v FROM nation GROUP BY 1, 2, 3)"


def tensor(s, d):
    return table(s, d, "nation").groupBy(F.col("n_regionkey").alias("i"), (F.col("n_nationkey") % 4).alias("j"), (F.col("n_nationkey") % 3).alias("k")).agg(F.sum(F.col("n_nationkey").cast("double")).alias("v"))


def matrix(s, d):
    return table(s, d, "nation").selectExpr("n_nationkey % 2 AS i", "cast(floor(n_nationkey / 2) as int) AS j", "n_nationkey * 0.5D AS v")


_M = "(SELECT n_nationkey % 2 AS i, n_nationkey // 2 AS j, n_nationkey * 0.5::DOUBLE AS v FROM nation)"
SIZES = {"j": 4, "k": 3}
C.add("tensor_unfold", lambda s, d: tn.unfold(tensor(s, d), "i", ["j", "k"], SIZES), f"SELECT i AS row, j * 3 + k AS col, v FROM {_T}", "v", "col")
C.add("tensor_fold", lambda s, d: (lambda t: t.select("i", F.col("j").cast("long").alias("j"), F.col("k").cast("long").alias("k"), "v"))(tn.fold(tn.unfold(tensor(s, d), "i", ["j", "k"], SIZES), "i", ["j", "k"], SIZES)), f"SELECT * FROM {_T}", "v", "j k")
C.add("tensor_mode_dot", lambda s, d: tn.mode_dot(tensor(s, d), matrix(s, d), "j"), f"SELECT m.i AS j, t.i AS i, k, sum(t.v * m.v) AS v FROM {_T} t JOIN {_M} m ON m.j = t.j GROUP BY 1, 2, 3", "v")
C.add("khatri_rao", lambda s, d: (lambda m: tn.khatri_rao(m, m, 2))(matrix(s, d).withColumnRenamed("j", "r")), f"SELECT a.i * 2 + b.i AS i, a.j AS r, a.v * b.v AS v FROM {_M} a JOIN {_M} b ON a.j = b.j", "v")
C.add("tensor_from_factors", lambda s, d: (lambda m: tn.from_factors(m, m, m))(matrix(s, d).withColumnRenamed("j", "r")), f"SELECT a.i AS i, b.i AS j, c.i AS k, sum(a.v * b.v * c.v) AS v FROM {_M} a JOIN {_M} b ON a.j = b.j JOIN {_M} c ON a.j = c.j GROUP BY 1, 2, 3", "v")
_CDF = f"""(SELECT v, lead(v) OVER (ORDER BY v) - v AS step, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb
  FROM (SELECT q AS v, sum(CASE WHEN p = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN p = 1 THEN 1 ELSE 0 END) AS b FROM {SCORED} GROUP BY 1))"""
C.add("energy_distance", lambda s, d: tn.energy_distance_1d(scored(s, d), "p", "q"), f"SELECT 2 * sum((fa - fb) * (fa - fb) * step) AS energy FROM {_CDF}", "energy", digits=8)
C.add("wasserstein_distance", lambda s, d: tn.wasserstein_1d(scored(s, d), "p", "q"), f"SELECT sum(abs(fa - fb) * step) AS wasserstein FROM {_CDF}", "wasserstein")
C.add("integral_image", lambda s, d: tn.integral_image(table(s, d, "part").selectExpr("p_partkey % 3 AS img", "cast(floor(p_partkey / 30) as bigint) AS y", "cast(floor(p_partkey / 3) % 10 as bigint) AS x", "p_size AS v"), "img", "y", "x", "v").select("img", "y", "x", F.col("area").cast("long").alias("area")),
      """WITH p AS (SELECT p_partkey % 3 AS img, p_partkey // 30 AS y, (p_partkey // 3) % 10 AS x, p_size AS v FROM part), r AS (SELECT *, sum(v) OVER (PARTITION BY img, y ORDER BY x) AS r FROM p)
      SELECT img, y, x, sum(r) OVER (PARTITION BY img, x ORDER BY y) AS area FROM r""", "", "area")
C.add("dummy_classifier", lambda s, d: (lambda df: df.select("id", dec.dummy_class(df, "label").alias("predicted")))(scored(s, d)), f"SELECT id, (SELECT label FROM {SCORED} GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) AS predicted FROM {SCORED}")
C.add("dummy_regressor", lambda s, d: (lambda df: df.select("id", dec.dummy_value(df, "price", "median").alias("predicted")))(scored(s, d)), f"SELECT id, (SELECT median(price) FROM {SCORED}) AS predicted FROM {SCORED}", "predicted")


def probabilities():
    return F.array(F.col("disc") * 4, F.col("tax") * 4, 1 - (F.col("disc") + F.col("tax")) * 4)


_P3 = f"(SELECT event_id AS id, value / 1000 AS a, (user_id % 10) / 20.0::DOUBLE AS b, 1 - value / 1000 - (user_id % 10) / 20.0::DOUBLE AS c FROM events)"


def proba(s, d):
    e = table(s, d, "events").selectExpr("event_id AS id", "value / 1000 AS a", "(user_id % 10) / 20.0D AS b", "1 - value / 1000 - (user_id % 10) / 20.0D AS c")
    return e.select("id", F.array("a", "b", "c").alias("p"))


C.add("uncertainty_sampling", lambda s, d: dec.query_rows(proba(s, d), dec.uncertainty(F.col("p")), "id", 25).select("id"), f"SELECT id FROM {_P3} ORDER BY 1 - greatest(a, b, c) DESC, id LIMIT 25")
C.add("margin_sampling", lambda s, d: dec.query_rows(proba(s, d), -dec.margin(F.col("p")), "id", 25).select("id"), f"SELECT id FROM {_P3} ORDER BY -(greatest(a, b, c) - list_sort([a, b, c])[2]) DESC, id LIMIT 25")
C.add("entropy", lambda s, d: proba(s, d).select("id", dec.entropy(F.col("p")).alias("h")),
      f"SELECT id, (CASE WHEN a > 0 THEN -a * ln(a) ELSE 0 END) + (CASE WHEN b > 0 THEN -b * ln(b) ELSE 0 END) + (CASE WHEN c > 0 THEN -c * ln(c) ELSE 0 END) AS h FROM {_P3}", "h")
C.add("softmax", lambda s, d: proba(s, d).select("id", col.softmax(F.col("p"))[0].alias("s")), f"SELECT id, exp(a) / (exp(a) + exp(b) + exp(c)) AS s FROM {_P3}", "s")
C.add("energy_score", lambda s, d: proba(s, d).select("id", col.energy_score(F.col("p"), 0.5).alias("e")), f"SELECT id, -0.5 * ln(exp(a / 0.5) + exp(b / 0.5) + exp(c / 0.5)) AS e FROM {_P3}", "e")
C.add("crps_ensemble", lambda s, d: proba(s, d).select("id", col.crps_ensemble(F.col("p"), F.lit(0.3)).alias("crps")),
      f"SELECT id, (abs(a - 0.3) + abs(b - 0.3) + abs(c - 0.3)) / 3 - (abs(a - b) + abs(a - c) + abs(b - c)) * 2 / 18 AS crps FROM {_P3}", "crps")
C.add("activations", lambda s, d: table(s, d, "events").select("event_id", col.sigmoid(F.col("value") / 100 - 1).alias("sg"), col.gelu(F.col("value") / 100 - 1).alias("ge"), col.leaky_relu(F.col("value") / 100 - 1).alias("lr"), col.soft_threshold(F.col("value") / 100 - 1, 0.2).alias("st")),
      """SELECT event_id, 1 / (1 + exp(-x)) AS sg, 0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))) AS ge, CASE WHEN x > 0 THEN x ELSE 0.01 * x END AS lr, sign(x) * greatest(abs(x) - 0.2, 0) AS st FROM (SELECT event_id, value / 100 - 1 AS x FROM events)""", "sg ge lr st")
C.add("acquisition_functions", lambda s, d: table(s, d, "part").select("p_partkey", dec.upper_confidence_bound(F.col("p_retailprice") / 1000, F.col("p_size") / 50).alias("ucb"), dec.expected_improvement(F.col("p_retailprice") / 1000, F.col("p_size") / 50, 1.5).alias("ei"), dec.probability_of_improvement(F.col("p_retailprice") / 1000, F.col("p_size") / 50, 1.5).alias("pi")))
C.add("histogram_binning", lambda s, d: dec.histogram_binning(scored(s, d), "y", "tax", 20).groupBy("tax").agg(F.max("calibrated").alias("calibrated")),
      f"""WITH f AS (SELECT least(floor(tax * 20), 19) AS b, avg(y) AS v FROM {SCORED} GROUP BY 1), x AS (SELECT DISTINCT tax, greatest(ceil(tax * 20) - 1, 0) AS pos FROM {SCORED}) SELECT tax, coalesce(v, (pos + 0.5) / 20) AS calibrated FROM x LEFT JOIN f ON f.b = pos""", "tax calibrated")
C.add("adaptive_prediction_sets", lambda s, d: (lambda df: df.select("id", F.size(dec.prediction_set(F.col("p"), dec.set_size_threshold(df, F.col("p"), (F.col("id") % 3).cast("int")))).cast("long").alias("n")))(proba(s, d).where("array_min(p) >= 0")))
C.add("accumulated_local_effects", lambda s, d: dec.accumulated_effects(scored(s, d), "q", lambda x: x * x, 10).select(F.col("bin").cast("long").alias("bin"), "n", "effect"),
      f"""WITH e AS (SELECT quantile_cont(q, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM {SCORED}), b AS (SELECT q, e, least(len(list_filter(e, lambda v: v <= q)), 10) AS b FROM {SCORED}, e),
      g AS (SELECT b - 1 AS bin, count(*) AS n, avg(e[b + 1] * e[b + 1] - e[b] * e[b]) AS d FROM b GROUP BY 1), a AS (SELECT bin, n, sum(d) OVER (ORDER BY bin) AS a FROM g) SELECT bin, n, a - avg(a) OVER () AS effect FROM a""", "effect", "bin")
C.add("rbf_sampler", lambda s, d: pre.rbf_sample(scored(s, d), ["disc", "tax"], [[1.0, 2.0], [-0.5, 3.0]], [0.1, 1.2]).select("id", "rff0", "rff1"),
      f"SELECT id, cos(disc + 2 * tax + 0.1) AS rff0, cos(-0.5 * disc + 3 * tax + 1.2) AS rff1 FROM {SCORED}", "rff0 rff1")
C.add("random_projection", lambda s, d: pre.random_projection(scored(s, d), ["q", "disc"], [[0.6, -0.8]]).select("id", "rp0"), f"SELECT id, 0.6 * q - 0.8 * disc AS rp0 FROM {SCORED}", "rp0")
