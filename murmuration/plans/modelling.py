"""Linear, Bayesian, tree, cluster, anomaly, neighbour, sketch and causal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learners as ml
from ..operators import linear as lin
from ..operators import metrics as met
from ..session import table
from .inputs import SCORED, Catalog, scored

C = Catalog()
NUM = ["q", "disc", "tax"]

C.add("covariance", lambda s, d: lin.covariance(scored(s, d), ["q", "disc"]),
      f"SELECT a, b, CASE WHEN a = b AND a = 'q' THEN var_pop(q) WHEN a = b THEN var_pop(disc) ELSE covar_pop(q, disc) END AS cov FROM {SCORED}, (SELECT unnest(['q', 'disc']) AS a), (SELECT unnest(['q', 'disc']) AS b) GROUP BY a, b", "cov")
C.add("mahalanobis", lambda s, d: lin.mahalanobis(scored(s, d), ["q", "disc"]).select("id", "distance2"),
      f"""WITH m AS (SELECT avg(q) AS a, avg(disc) AS b, var_pop(q) AS x, var_pop(disc) AS y, covar_pop(q, disc) AS z FROM {SCORED})
      SELECT id, (m.y * (q-a)*(q-a) - 2 * z * (q-a)*(disc-b) + m.x * (disc-b)*(disc-b)) / (m.x*m.y - z*z) AS distance2 FROM {SCORED}, m""", "distance2")
C.add("ols", lambda s, d: lin.ols(scored(s, d), ["q"], "price").select("term", "coefficient", "se", "r2"),
      f"""WITH m AS (SELECT regr_slope(price, q) AS b, regr_intercept(price, q) AS a, regr_r2(price, q) AS r2, regr_sxx(price, q) AS sxx, regr_syy(price, q) AS syy, count(*) AS n, avg(q) AS mx FROM {SCORED}),
      e AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM m)
      SELECT 'intercept' AS term, a AS coefficient, sqrt(s2 * (1 / n + mx * mx / sxx)) AS se, r2 FROM e UNION ALL SELECT 'q', b, sqrt(s2 / sxx), r2 FROM e""", "coefficient se r2", digits=3)
C.add("ols_inference", lambda s, d: lin.ols(scored(s, d), NUM, "price"))
C.add("ridge", lambda s, d: lin.ridge(scored(s, d), ["q"], "price", 50.0).table(s),
      f"""WITH m AS (SELECT covar_pop(price, q) * count(*) AS xy, var_pop(q) * count(*) AS xx, avg(q) AS mx, avg(price) AS my FROM {SCORED})
      SELECT 'intercept' AS term, my - mx * xy / (xx + 50) AS coefficient FROM m UNION ALL SELECT 'q', xy / (xx + 50) FROM m""", "coefficient", digits=3)
C.add("lasso", lambda s, d: lin.elastic_net(scored(s, d), ["q"], "price", 20.0).table(s),
      f"""WITH m AS (SELECT covar_pop(price, q) AS xy, var_pop(q) AS xx, avg(q) AS mx, avg(price) AS my FROM {SCORED}), b AS (SELECT *, sign(xy) * greatest(abs(xy) - 20, 0) / xx AS b FROM m)
      SELECT 'intercept' AS term, my - mx * b AS coefficient FROM b UNION ALL SELECT 'q', b FROM b""", "coefficient", digits=3)
C.add("elastic_net", lambda s, d: lin.elastic_net(scored(s, d), ["q"], "price", 20.0, 0.5).table(s),
      f"""WITH m AS (SELECT covar_pop(price, q) AS xy, var_pop(q) AS xx, avg(q) AS mx, avg(price) AS my FROM {SCORED}), b AS (SELECT *, sign(xy) * greatest(abs(xy) - 10, 0) / (xx + 10) AS b FROM m)
      SELECT 'intercept' AS term, my - mx * b AS coefficient FROM b UNION ALL SELECT 'q', b FROM b""", "coefficient", digits=3)


def _newton(mean, weight, y, x, rounds, start, ridge="0"):
    """Newton rounds of a one-feature model with an intercept, unrolled."""
    steps = [f"d AS MATERIALIZED (SELECT {x} AS x, {y}::DOUBLE AS y FROM {SCORED})", f"b0 AS (SELECT {start} AS a, 0.0::DOUBLE AS b)"]
    for i in range(rounds):
        steps.append(f"""m{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(w) AS h00, sum(w * x) AS h01, sum(w * x * x) + {ridge} AS h11, sum(y - mu) AS g0, sum((y - mu) * x) - {ridge} * any_value(b) AS g1
          FROM (SELECT a, b, x, y, mu, {weight} AS w FROM (SELECT a, b, x, y, {mean} AS mu FROM d, b{i})))""")
        steps.append(f"b{i + 1} AS (SELECT a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM m{i})")
    return f"WITH {', '.join(steps)} SELECT 'intercept' AS term, a AS coefficient FROM b{rounds} UNION ALL SELECT 'z', b FROM b{rounds}"


C.add("logistic_regression", lambda s, d: lin.logistic(scored(s, d).withColumn("z", F.col("q") / 50), ["z"], "y").table(s),
      _newton("1 / (1 + exp(-(a + b * x)))", "mu * (1 - mu)", "y", "q / 50", 8, "0.0::DOUBLE", "1"), "coefficient", digits=5)
C.add("logistic_regression_2", lambda s, d: lin.logistic(scored(s, d).withColumn("z", F.col("q") / 50), ["z", "disc"], "y").table(s))
C.add("poisson_glm", lambda s, d: lin.weighted_rounds(scored(s, d).withColumn("z", F.col("price") / 50000), ["z"], "q", "poisson").table(s),
      _newton("exp(a + b * x)", "mu", "q", "price / 50000", 8, f"(SELECT ln(avg(q)) FROM {SCORED})"), "coefficient", digits=5)
C.add("pca", lambda s, d: lin.pca_table(scored(s, d).withColumn("p2", F.col("price") / 1000), ["q", "p2"], 1),
      f"""WITH m AS (SELECT var_samp(q) AS x, var_samp(price/1000) AS y, covar_samp(q, price/1000) AS z FROM {SCORED}), e AS (SELECT *, (x+y)/2 + sqrt((x-y)*(x-y)/4 + z*z) AS l FROM m), v AS (SELECT l, z / sqrt(z*z + (l-x)*(l-x)) AS a, (l-x) / sqrt(z*z + (l-x)*(l-x)) AS b FROM e),
      g AS (SELECT l, CASE WHEN abs(a) >= abs(b) THEN sign(a) ELSE sign(b) END AS s, a, b FROM v)
      SELECT 0 AS component, 'q' AS feature, a * s AS loading, l AS variance FROM g UNION ALL SELECT 0, 'p2', b * s, l FROM g""", "loading variance", digits=5)
C.queries["pca"] = (lambda q: lambda s, d: q(s, d).withColumn("component", F.col("component").cast("int")))(C.queries["pca"])
C.add("pca_transform", lambda s, d: lin.pca_transform(scored(s, d), NUM, 2).select("id", "pc0", "pc1"))
C.add("instrumental_variables", lambda s, d: lin.two_stage(scored(s, d), ["disc"], "q", "price").table(s).where("term = 'q'").select("coefficient"),
      f"SELECT covar_pop(disc, price) / covar_pop(disc, q) AS coefficient FROM {SCORED}", "coefficient", digits=2)
C.add("regression_discontinuity", lambda s, d: lin.discontinuity(scored(s, d), "q", "price", 25.0, 8.0),
      f"""WITH n AS (SELECT q - 25 AS x, price AS y FROM {SCORED} WHERE abs(q - 25) <= 8)
      SELECT (SELECT regr_intercept(y, x) FROM n WHERE x >= 0) - (SELECT regr_intercept(y, x) FROM n WHERE x < 0) AS effect, (SELECT count(*) FROM n) AS n""", "effect", "n", digits=3)
C.add("inverse_propensity", lambda s, d: lin.propensity_weighted(scored(s, d), "p", "price", 0.2 + F.col("tax") * 5),
      f"""SELECT sum(p * price / e) / sum(p / e) - sum((1 - p) * price / (1 - e)) / sum((1 - p) / (1 - e)) AS ate FROM (SELECT *, least(greatest(0.2 + tax * 5, 0.001), 0.999) AS e FROM {SCORED})""", "ate", digits=3)
C.add("doubly_robust", lambda s, d: lin.doubly_robust(scored(s, d), "p", "price", ["q", "disc"]))
C.add("difference_in_differences", lambda s, d: lin.difference_in_differences(scored(s, d).withColumn("after", (F.col("g") == "O").cast("int")), "p", "after", "price"),
      f"""SELECT (avg(price) FILTER (p = 1 AND g = 'O') - avg(price) FILTER (p = 1 AND g <> 'O')) - (avg(price) FILTER (p = 0 AND g = 'O') - avg(price) FILTER (p = 0 AND g <> 'O')) AS effect FROM {SCORED}""", "effect", digits=3)

_GNB = f"""WITH g AS (SELECT label, count(*)::DOUBLE AS n, avg(q) AS m1, var_pop(q) AS v1, avg(disc) AS m2, var_pop(disc) AS v2 FROM {SCORED} GROUP BY 1),
  t AS (SELECT sum(n) AS nn, 1e-9 * (SELECT greatest(var_pop(q), var_pop(disc)) FROM {SCORED}) AS eps FROM g),
  c AS (SELECT id, g.label, ln(n / nn) - 0.5 * ln(2 * pi() * (v1 + eps)) - (q - m1) * (q - m1) / (2 * (v1 + eps)) - 0.5 * ln(2 * pi() * (v2 + eps)) - (disc - m2) * (disc - m2) / (2 * (v2 + eps)) AS sc FROM {SCORED} s, g, t)
  SELECT predicted, count(*) AS n FROM (SELECT id, arg_max(label, sc) AS predicted FROM (SELECT rid AS id, g.label, ln(n / nn) - 0.5 * ln(2 * pi() * (v1 + eps)) - (q - m1) * (q - m1) / (2 * (v1 + eps)) - 0.5 * ln(2 * pi() * (v2 + eps)) - (disc - m2) * (disc - m2) / (2 * (v2 + eps)) AS sc
  FROM (SELECT *, row_number() OVER () AS rid FROM {SCORED}) s, g, t) GROUP BY id) GROUP BY 1"""
C.add("gaussian_nb", lambda s, d: (lambda df: df.select(ml.gaussian_nb(df, "label", ["q", "disc"]).alias("predicted")).groupBy("predicted").agg(F.count("*").alias("n")))(scored(s, d)), _GNB, "", "n")
_CNT = "(SELECT event_id, event_type, CAST(floor(value / 10) AS BIGINT) AS a, user_id % 7 AS b, user_id % 3 AS c FROM events)"


def counts(s, d):
    return table(s, d, "events").selectExpr("event_id", "event_type", "cast(floor(value / 10) as bigint) AS a", "user_id % 7 AS b", "user_id % 3 AS c")


def _nb(kind):
    return lambda s, d: (lambda df: df.select("event_id", ml.count_nb(df, "event_type", ["a", "b", "c"], kind).alias("predicted")))(counts(s, d))


_S = f"(SELECT event_type AS label, count(*)::DOUBLE AS n, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb, sum(c)::DOUBLE AS sc FROM {_CNT} GROUP BY 1)"
_BEST = "SELECT event_id, min(label) AS predicted FROM (SELECT *, max(s) OVER (PARTITION BY event_id) AS top FROM z) WHERE s >= top - 1e-9 GROUP BY 1"
C.add("multinomial_nb", _nb("multinomial"),
      f"""WITH k AS (SELECT *, sa + sb + sc + 3 AS t, sum(n) OVER () AS nn FROM {_S}), z AS (SELECT event_id, label, ln(n / nn) + a * ln((sa + 1) / t) + b * ln((sb + 1) / t) + c * ln((sc + 1) / t) AS s FROM {_CNT}, k) {_BEST}""")
C.add("complement_nb", _nb("complement"),
      f"""WITH k AS (SELECT label, sum(sa) OVER () - sa + 1 AS xa, sum(sb) OVER () - sb + 1 AS xb, sum(sc) OVER () - sc + 1 AS xc FROM {_S}), z AS (SELECT event_id, label, -(a * ln(xa / (xa+xb+xc)) + b * ln(xb / (xa+xb+xc)) + c * ln(xc / (xa+xb+xc))) AS s FROM {_CNT}, k) {_BEST}""")
C.add("bernoulli_nb", _nb("bernoulli"),
      f"""WITH p AS (SELECT event_type AS label, count(*)::DOUBLE AS n, (sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) + 1.0) / (count(*) + 2) AS pa, (sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) + 1.0) / (count(*) + 2) AS pb, (sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) + 1.0) / (count(*) + 2) AS pc FROM {_CNT} GROUP BY 1),
      k AS (SELECT *, sum(n) OVER () AS nn FROM p), z AS (SELECT event_id, label, ln(n / nn) + ln(CASE WHEN a > 0 THEN pa ELSE 1 - pa END) + ln(CASE WHEN b > 0 THEN pb ELSE 1 - pb END) + ln(CASE WHEN c > 0 THEN pc ELSE 1 - pc END) AS s FROM {_CNT}, k) {_BEST}""")
C.add("nearest_centroid", lambda s, d: (lambda df: df.select("event_id", ml.nearest_centroid(df, "event_type", ["a", "b", "c"]).alias("predicted")))(counts(s, d)),
      f"""WITH k AS (SELECT label, sa / n AS xa, sb / n AS xb, sc / n AS xc FROM {_S}), z AS (SELECT event_id, label, -((a-xa)*(a-xa) + (b-xb)*(b-xb) + (c-xc)*(c-xc)) AS s FROM {_CNT}, k) {_BEST}""")


def _start(s, d):
    """Rows 0, 1 and 2 as the first centres."""
    rows = table(s, d, "embeddings").where("vec_id < 3").orderBy("vec_id").collect()
    return [[float(x) for x in r.embedding] for r in rows]


_DIST = "list_sum([power(z[1] - z[2], 2) FOR z IN list_zip(v, c)])"


def _lloyd(rounds):
    steps = ["x AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", "p0 AS MATERIALIZED (SELECT vec_id AS k, v AS c FROM x WHERE vec_id < 3)"]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(k, ({_DIST}, k)) AS k FROM x, p{i} GROUP BY vec_id)")
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(v[i]) AS m FROM (SELECT k, v, unnest(range(1, len(v) + 1)) AS i FROM a{i}) GROUP BY 1, 2) GROUP BY k)")
    return f"WITH {', '.join(steps)} SELECT vec_id, arg_min(k, ({_DIST}, k)) AS cluster, min({_DIST}) AS distance2 FROM x, p{rounds} GROUP BY vec_id"


C.add("kmeans", lambda s, d: (lambda e: ml.assigned(e, "embedding", ml.k_means_vectors(e, "embedding", _start(s, d), 3)).groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.sum("distance2").alias("inertia")))(table(s, d, "embeddings")),
      f"SELECT cluster, count(*) AS n, sum(distance2) AS inertia FROM ({_lloyd(3)}) GROUP BY 1", "inertia", "cluster", digits=4)
C.add("kmeans_assign", lambda s, d: ml.assigned(table(s, d, "embeddings"), "embedding", _start(s, d)).select("vec_id", F.col("cluster").cast("long").alias("cluster"), "distance2"), _lloyd(0), "distance2", "cluster")
_NEAR = "(SELECT a.i AS id, b.i AS other FROM p a JOIN p b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.64)"
C.add("dbscan", lambda s, d: ml.grid_dbscan(table(s, d, "part").selectExpr("p_partkey", "cast(p_size as double) AS x", "p_retailprice / 20 AS y"), ["x", "y"], "p_partkey", 0.8, 4),
      f"""WITH RECURSIVE p AS MATERIALIZED (SELECT p_partkey AS i, p_size::DOUBLE AS x, p_retailprice / 20 AS y FROM part), e AS MATERIALIZED {_NEAR}, k AS MATERIALIZED (SELECT id FROM e GROUP BY 1 HAVING count(*) >= 4),
      ke AS MATERIALIZED (SELECT e.id, other FROM e JOIN k ON k.id = e.id JOIN k j ON j.id = e.other), r(id, root) AS (SELECT id, id FROM k UNION SELECT ke.other, r.root FROM r JOIN ke ON ke.id = r.id), l AS (SELECT id, min(root) AS c FROM r GROUP BY 1),
      b AS (SELECT e.other AS id, min(c) AS c FROM e JOIN l ON l.id = e.id GROUP BY 1) SELECT p.i AS id, coalesce(l.c, b.c) AS cluster FROM p LEFT JOIN l ON l.id = p.i LEFT JOIN b ON b.id = p.i""")
def _stump(s, d):
    df = scored(s, d).withColumn("t", F.col("q") * F.col("disc"))
    return df.withColumn("predicted", ml.fit_tree(df, ["disc", "tax"], -F.col("t"), F.lit(1.0), 1, 32, 0.0).column()).groupBy("disc").agg(F.max("predicted").alias("predicted"), F.min("predicted").alias("least"))


# The best split of either feature: the greatest sum of squared sums over sizes of the two sides.
C.add("decision_tree", _stump, f"""WITH d AS MATERIALIZED (SELECT disc, tax, q * disc AS t FROM {SCORED}), v AS (SELECT disc AS x, 'disc' AS f, t FROM d UNION ALL SELECT tax, 'tax', t FROM d), g AS (SELECT f, x, sum(t) AS s, count(*) AS n FROM v GROUP BY 1, 2),
      c AS (SELECT f, x, sum(s) OVER w - s AS sl, sum(n) OVER w - n AS nl, sum(s) OVER (PARTITION BY f) AS sa, sum(n) OVER (PARTITION BY f) AS na FROM g WINDOW w AS (PARTITION BY f ORDER BY x)),
      b AS (SELECT arg_max(f, k) AS f, arg_max(x, k) AS x, arg_max(sl / nl, k) AS low, arg_max((sa - sl) / (na - nl), k) AS high FROM (SELECT *, sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) AS k FROM c WHERE nl > 0))
      SELECT disc, max(p) AS predicted, min(p) AS least FROM (SELECT d.disc, CASE WHEN CASE WHEN f = 'disc' THEN d.disc ELSE tax END < x THEN low ELSE high END AS p FROM d, b) GROUP BY disc""", "predicted least")
C.add("gradient_boosting", lambda s, d: (lambda df: met.roc_auc(df.withColumn("sc", ml.fit_boosting(df, NUM + ["price"], "y", 3, 0.3, "logistic", max_depth=2)), "y", "sc"))(scored(s, d)))
C.add("random_forest", lambda s, d: (lambda df: met.regression(df.withColumn("pr", ml.random_forest(df, ["q", "disc", "tax", "p"], "t", "id", 6, max_depth=4)), "t", "pr").select((F.col("r2") > 0.6).alias("explains")))(scored(s, d).withColumn("t", F.col("q") * F.col("disc"))), "SELECT true AS explains")
C.add("ada_boost", lambda s, d: (lambda df: df.agg((F.avg((ml.ada_boost(df, ["q", "disc", "tax"], "p", 4)[1] == F.col("p")).cast("double")) > 0.85).alias("learned")))(scored(s, d)), "SELECT true AS learned")
C.add("hbos", lambda s, d: ml.hbos(table(s, d, "events").select("event_id", "value"), ["value"]).select("event_id", "score"),
      """WITH m AS (SELECT min(value) AS l, (max(value) - min(value)) / 10 AS w, count(*) AS n FROM events), b AS (SELECT event_id, least(floor((value - l) / w), 9) AS b, w, n FROM events, m), c AS (SELECT b, count(*) AS k FROM b GROUP BY 1)
      SELECT event_id, ln(1 / (k / (n * w) + 1e-10)) AS score FROM b JOIN c USING (b)""", "score")
C.add("ecod_copod", lambda s, d: ml.tail_scores(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "p_partkey"),
      """WITH r AS (SELECT p_partkey AS id, cume_dist() OVER (ORDER BY p_size) AS a, cume_dist() OVER (ORDER BY p_size DESC) AS b, cume_dist() OVER (ORDER BY p_retailprice) AS c, cume_dist() OVER (ORDER BY p_retailprice DESC) AS e FROM part)
      SELECT id, -ln(least(a, b)) - ln(least(c, e)) AS ecod, greatest(-ln(a) - ln(c), -ln(b) - ln(e)) AS copod FROM r""", "ecod copod")
C.add("outliers_iqr", lambda s, d: ml.outliers_iqr(table(s, d, "events"), "value").select("event_id", "is_outlier"),
      "WITH q AS (SELECT quantile_cont(value, [0.25, 0.75]) AS a FROM events) SELECT event_id, value > a[2] + 1.5 * (a[2] - a[1]) AS is_outlier FROM events, q")
C.add("outliers_mad", lambda s, d: ml.outliers_mad(table(s, d, "events"), "value").select("event_id", "is_outlier"),
      "WITH m AS (SELECT median(value) AS m FROM events), k AS (SELECT m, median(abs(value - m)) AS k FROM events, m GROUP BY m) SELECT event_id, (value - m) / (1.4826 * (k + 1e-12)) > 3 AS is_outlier FROM events, k")
C.add("knn", lambda s, d: (lambda e: ml.knn(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 3).withColumn("rank", F.col("rank").cast("long")))(table(s, d, "embeddings")),
      """SELECT q, id, distance, rank FROM (SELECT a.vec_id AS q, b.vec_id AS id, sqrt(list_sum([power(x[1]::DOUBLE - x[2]::DOUBLE, 2) FOR x IN list_zip(a.embedding, b.embedding)])) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY
      sqrt(list_sum([power(x[1]::DOUBLE - x[2]::DOUBLE, 2) FOR x IN list_zip(a.embedding, b.embedding)])), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 3""", "distance", "rank")


def _bloom(s, d):
    large = table(s, d, "part").where("p_size > 25")
    bits = ml.bloom_bits(large.count())
    found = ml.bloom_contains(table(s, d, "lineitem"), "l_partkey", ml.bloom_filter(large, "p_partkey", bits, 4), bits, 4)
    both = found.join(large.select(F.col("p_partkey").alias("k")), F.col("l_partkey") == F.col("k"), "left")
    member = F.col("k").isNotNull()
    return both.agg(F.sum(member.cast("long")).alias("members"), F.sum((member & ~F.col("maybe")).cast("long")).alias("missed"), (F.sum((~member & F.col("maybe")).cast("long")) <= 0.02 * F.count("*")).alias("few_false"))


C.add("bloom_filter", _bloom, "SELECT count(*) AS members, CAST(0 AS BIGINT) AS missed, true AS few_false FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25")
C.add("hyperloglog", lambda s, d: table(s, d, "lineitem").agg((F.abs(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 14)) - F.count_distinct("l_partkey")) <= 0.03 * F.count_distinct("l_partkey")).alias("near"), F.count_distinct("l_partkey").alias("exact")),
      "SELECT true AS near, count(DISTINCT l_partkey) AS exact FROM lineitem")
C.add("quantile_sketch", lambda s, d: ml.quantiles_by_sketch(table(s, d, "lineitem"), "l_quantity", [0.1, 0.5, 0.9]).select(F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90")),
      "SELECT quantile_disc(l_quantity, 0.1) AS p10, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem", "p10 p50 p90")
C.add("reservoir_sample", lambda s, d: ml.reservoir(table(s, d, "orders"), 100, "o_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY md5('0:' || o_orderkey), o_orderkey LIMIT 100")
C.add("conformal_regressor", lambda s, d: ml.conformal_quantile(scored(s, d).withColumn("r", F.abs(F.col("price") - F.col("q") * 1500)), "r", 0.9),
      f"SELECT r AS q FROM (SELECT abs(price - q * 1500) AS r, row_number() OVER (ORDER BY abs(price - q * 1500)) AS k, count(*) OVER () AS n FROM {SCORED}) WHERE k = least(ceil((n + 1) * 0.9), n)", "q", digits=4)
C.add("mondrian_conformal", lambda s, d: ml.conformal_quantile(scored(s, d).withColumn("r", F.abs(F.col("price") - F.col("q") * 1500)), "r", 0.9, ["label"]),
      f"SELECT label, r AS q FROM (SELECT label, abs(price - q * 1500) AS r, row_number() OVER (PARTITION BY label ORDER BY abs(price - q * 1500)) AS k, count(*) OVER (PARTITION BY label) AS n FROM {SCORED}) WHERE k = least(ceil((n + 1) * 0.9), n)", "q", digits=4)
