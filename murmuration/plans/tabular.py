"""Preprocessing, encoders, metrics, selection and splits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encoders as enc
from ..operators import metrics as met
from ..operators import preprocessing as pre
from ..operators import selection as sel
from ..session import table
from .inputs import SCORED, Catalog, scored

C = Catalog()
NUM = ["q", "price", "disc", "tax"]


def _cols(df, *names):
    return df.select("id", *names)


def _scaled(fit):
    return lambda s, d: (lambda df: _cols(fit(df).transform(df), "q", "price"))(scored(s, d))


C.add("standard_scaler", _scaled(lambda df: pre.fit_standard(df, ["q", "price"])),
      f"SELECT id, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS q, (price - avg(price) OVER ()) / stddev_pop(price) OVER () AS price FROM {SCORED}", "q price")
C.add("min_max_scaler", _scaled(lambda df: pre.fit_min_max(df, ["q", "price"])),
      f"SELECT id, (q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()) AS q, (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) AS price FROM {SCORED}", "q price")
C.add("max_abs_scaler", _scaled(lambda df: pre.fit_max_abs(df, ["q", "price"])),
      f"SELECT id, q / max(abs(q)) OVER () AS q, price / max(abs(price)) OVER () AS price FROM {SCORED}", "q price")
C.add("robust_scaler", _scaled(lambda df: pre.fit_robust(df, ["q", "price"])),
      f"""WITH s AS (SELECT quantile_cont(q, [0.25, 0.5, 0.75]) a, quantile_cont(price, [0.25, 0.5, 0.75]) b FROM {SCORED})
      SELECT id, (q - a[2]) / (a[3] - a[1]) AS q, (price - b[2]) / (b[3] - b[1]) AS price FROM {SCORED}, s""", "q price")
C.add("normalizer_l2", lambda s, d: _cols(pre.normalize(scored(s, d), ["q", "disc", "tax"]), "q", "disc", "tax"),
      f"SELECT id, q / n AS q, disc / n AS disc, tax / n AS tax FROM (SELECT *, sqrt(q*q + disc*disc + tax*tax) AS n FROM {SCORED})", "q disc tax")
C.add("normalizer_l1", lambda s, d: _cols(pre.normalize(scored(s, d), ["q", "disc"], "l1"), "q", "disc"),
      f"SELECT id, q / (q + disc) AS q, disc / (q + disc) AS disc FROM {SCORED}", "q disc")
C.add("binarizer", lambda s, d: _cols(pre.binarize(scored(s, d), ["q"], 25.0), "q"), f"SELECT id, CASE WHEN q > 25 THEN 1.0 ELSE 0.0 END AS q FROM {SCORED}", "q")
C.add("polynomial_features",
      lambda s, d: pre.polynomial(scored(s, d).select("id", "q", "disc"), ["q", "disc"]).select("id", F.col("1").alias("one"), F.col("`q*q`").alias("qq"), F.col("`q*disc`").alias("qd"), F.col("`disc*disc`").alias("dd")),
      f"SELECT id, 1.0 AS one, q*q AS qq, q*disc AS qd, disc*disc AS dd FROM {SCORED}", "one qq qd dd")
C.add("kbins_quantile", lambda s, d: pre.discretize(scored(s, d), "price", 5).groupBy("bin").count().withColumn("bin", F.col("bin").cast("long")),
      f"""WITH e AS (SELECT quantile_cont(price, [0.2, 0.4, 0.6, 0.8]) a FROM {SCORED})
      SELECT CAST(price >= a[1] AS INT) + CAST(price >= a[2] AS INT) + CAST(price >= a[3] AS INT) + CAST(price >= a[4] AS INT) AS bin, count(*) AS count FROM {SCORED}, e GROUP BY 1""", "", "bin count")
C.add("kbins_uniform", lambda s, d: pre.discretize(scored(s, d), "q", 4, "uniform").groupBy("bin").count().withColumn("bin", F.col("bin").cast("long")),
      f"SELECT CAST(least(floor((q - 1) / 12.25), 3) AS BIGINT) AS bin, count(*) AS count FROM {SCORED} GROUP BY 1", "", "bin count")
C.add("quantile_transformer", lambda s, d: _cols(pre.quantile_transform(scored(s, d), "disc", 11), "q").select("id", "q"),
      f"""WITH l AS (SELECT quantile_cont(disc, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) a FROM {SCORED})
      SELECT id, CASE WHEN disc <= a[1] THEN 0.0 WHEN disc >= a[11] THEN 1.0 ELSE (k - 1 + (disc - a[k]) / CASE WHEN a[k+1] = a[k] THEN 1 ELSE a[k+1] - a[k] END) / 10.0 END AS q
      FROM (SELECT id, disc, a, len(list_filter(a, lambda v: v <= disc)) AS k FROM {SCORED}, l)""", "q")
C.add("ordinal_encoder", lambda s, d: pre.ordinal_encode(table(s, d, "customer"), "c_mktsegment").select("c_custkey", F.col("code").cast("long").alias("code")),
      "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer", "", "code")
C.add("label_encoder", lambda s, d: pre.label_encode(table(s, d, "part"), "p_brand").select("p_partkey", F.col("code").cast("long").alias("code")),
      "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part", "", "code")
C.add("one_hot_encoder", lambda s, d: (lambda df: df.select("id", F.col("`label=A`").alias("a"), F.col("`label=N`").alias("n"), F.col("`label=R`").alias("r")))(pre.one_hot(scored(s, d), "label")),
      f"SELECT id, CASE WHEN label='A' THEN 1.0 ELSE 0.0 END AS a, CASE WHEN label='N' THEN 1.0 ELSE 0.0 END AS n, CASE WHEN label='R' THEN 1.0 ELSE 0.0 END AS r FROM {SCORED}", "a n r")
C.add("label_binarizer", lambda s, d: pre.label_binarize(scored(s, d), "g").select("id", F.col("`g=O`").cast("long").alias("o")),
      f"SELECT id, CASE WHEN g = 'O' THEN 1 ELSE 0 END AS o FROM {SCORED}", "", "o")

_HOLES = "(SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer)"


def _holes(s, d):
    return table(s, d, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END").alias("b"))


C.add("imputer_mean", lambda s, d: pre.impute(_holes(s, d), ["b"]), f"SELECT c_custkey, coalesce(b, avg(b) OVER ()) AS b FROM {_HOLES}", "b")
C.add("imputer_median", lambda s, d: pre.impute(_holes(s, d), ["b"], "median"), f"SELECT c_custkey, coalesce(b, (SELECT median(b) FROM {_HOLES})) AS b FROM {_HOLES}", "b")
C.add("imputer_most_frequent", lambda s, d: pre.impute(table(s, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS v"), ["v"], "most_frequent"),
      """WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS v FROM part),
      m AS (SELECT v FROM h WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)
      SELECT p_partkey, coalesce(h.v, m.v) AS v FROM h, m""", "v")
C.add("missing_indicator", lambda s, d: pre.missing_indicator(_holes(s, d), ["b"]).select("c_custkey", "b_missing"), f"SELECT c_custkey, b IS NULL AS b_missing FROM {_HOLES}")
C.add("winsorizer", lambda s, d: _cols(pre.winsorize(scored(s, d), ["price"]), "price"),
      f"WITH l AS (SELECT quantile_cont(price, [0.05, 0.95]) a FROM {SCORED}) SELECT id, greatest(a[1], least(a[2], price)) AS price FROM {SCORED}, l", "price")
C.add("date_time_features", lambda s, d: pre.date_parts(table(s, d, "orders"), "o_orderdate").select("o_orderkey", *[F.col(c).cast("long").alias(c) for c in ("year", "month", "day", "dow", "doy", "hour", "quarter", "weekend")], "month_sin", "dow_cos"),
      """SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, isodow(o_orderdate) - 1 AS dow, dayofyear(o_orderdate) AS doy,
      hour(o_orderdate) AS hour, quarter(o_orderdate) AS quarter, CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS weekend,
      sin(month(o_orderdate) * 2 * pi() / 12) AS month_sin, cos((isodow(o_orderdate) - 1) * 2 * pi() / 7) AS dow_cos FROM orders""", "month_sin dow_cos", "year month day dow doy hour quarter weekend")
C.add("cyclical_encoder", lambda s, d: pre.cyclical(table(s, d, "part"), "p_size", 50.0).select("p_partkey", "p_size_sin", "p_size_cos"),
      "SELECT p_partkey, sin(p_size * 2 * pi() / 50) AS p_size_sin, cos(p_size * 2 * pi() / 50) AS p_size_cos FROM part", "p_size_sin p_size_cos")

# Encoders of a category against a 0/1 target.
_G = f"(SELECT brand, count(*) AS n, sum(y) AS s, avg(y) AS m, var_pop(y) AS v FROM {SCORED} GROUP BY brand)"
_ALL = f"(SELECT avg(y) AS gm, var_pop(y) AS gv, count(*) AS gn, sum(y) AS gs FROM {SCORED})"


def _encoded(fit):
    return lambda s, d: (lambda df: fit(df).transform(df, "brand").select("id", "encoded"))(scored(s, d))


def y():
    return F.col("y").cast("double")


def _enc_sql(expression):
    return f"SELECT id, {expression} AS encoded FROM {SCORED} a JOIN {_G} b ON a.brand = b.brand, {_ALL}"


C.add("target_encode_mestimate", _encoded(lambda df: enc.fit_m_estimate(df, "brand", y())), _enc_sql("(s + gm) / (n + 1)"), "encoded")
C.add("target_encoder", _encoded(lambda df: enc.fit_target(df, "brand", y())), _enc_sql("(s + 10 * gm) / (n + 10)"), "encoded")
C.add("woe_encoder", _encoded(lambda df: enc.fit_woe(df, "brand", y())), _enc_sql("ln(((s + 0.5) / gs) / ((n - s + 0.5) / (gn - gs)))"), "encoded")
C.add("james_stein_encoder", _encoded(lambda df: enc.fit_james_stein(df, "brand", y())),
      f"""WITH t AS (SELECT var_pop(m) AS tau FROM {_G}) SELECT id, w * m + (1 - w) * gm AS encoded
      FROM (SELECT id, m, gm, tau / (tau + gv / n) AS w FROM {SCORED} a JOIN {_G} b ON a.brand = b.brand, {_ALL}, t)""", "encoded")
C.add("count_encoder", _encoded(lambda df: enc.fit_count(df, "brand")), f"SELECT id, count(*) OVER (PARTITION BY brand) AS encoded FROM {SCORED}", "encoded")
C.add("frequency_encoder", _encoded(lambda df: enc.fit_count(df, "brand", True)), f"SELECT id, count(*) OVER (PARTITION BY brand) / count(*) OVER () AS encoded FROM {SCORED}", "encoded")
C.add("leave_one_out_encoder", lambda s, d: enc.leave_one_out(scored(s, d), "brand", "y").select("id", "encoded"),
      f"SELECT id, (sum(y) OVER (PARTITION BY brand) - y) / (count(*) OVER (PARTITION BY brand) - 1) AS encoded FROM {SCORED}", "encoded")
C.add("ordered_target_statistic", lambda s, d: enc.ordered_target_statistic(table(s, d, "orders").withColumn("y", F.expr("CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END").cast("double")), "o_orderpriority", "y", ["o_orderkey"]).select("o_orderkey", "encoded"),
      """WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders), g AS (SELECT avg(y) AS gm FROM o)
      SELECT o_orderkey, (coalesce(sum(y) OVER w, 0) + gm) / (count(y) OVER w + 1) AS encoded FROM o, g
      WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "encoded")
C.add("rare_label_encoder", lambda s, d: enc.rare_labels(table(s, d, "part"), "p_type", 0.05).groupBy("p_type").count(),
      "SELECT CASE WHEN c >= 0.05 * t THEN p_type ELSE 'Rare' END AS p_type, count(*) AS count FROM (SELECT p_type, count(*) OVER (PARTITION BY p_type) c, count(*) OVER () t FROM part) GROUP BY 1")
C.add("binary_encoder", lambda s, d: enc.binary_encode(table(s, d, "customer"), "c_mktsegment").select("c_custkey", *[F.col(f"c_mktsegment_b{i}").cast("long").alias(f"b{i}") for i in (2, 1, 0)]),
      "SELECT c_custkey, (r >> 2) & 1 AS b2, (r >> 1) & 1 AS b1, r & 1 AS b0 FROM (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) AS r FROM customer)", "", "b2 b1 b0")
C.add("deep_feature_synthesis", lambda s, d: enc.deep_features(table(s, d, "orders"), "o_custkey", ["o_totalprice"], ("mean", "std", "max", "min", "sum", "median", "count")).select("o_orderkey", "o_totalprice_mean", "o_totalprice_std", "o_totalprice_max", "o_totalprice_min", "o_totalprice_sum", "o_totalprice_median", "n_rows"),
      """WITH g AS (SELECT o_custkey, avg(o_totalprice) a, stddev_pop(o_totalprice) s, max(o_totalprice) x, min(o_totalprice) n, sum(o_totalprice) t, median(o_totalprice) m, count(*) c FROM orders GROUP BY 1)
      SELECT o_orderkey, a AS o_totalprice_mean, s AS o_totalprice_std, x AS o_totalprice_max, n AS o_totalprice_min, t AS o_totalprice_sum, m AS o_totalprice_median, c AS n_rows FROM orders JOIN g USING (o_custkey)""",
      "o_totalprice_mean o_totalprice_std o_totalprice_max o_totalprice_min o_totalprice_sum o_totalprice_median", digits=4)

# Metrics.
C.add("accuracy", lambda s, d: met.accuracy(scored(s, d), "y", "p"), f"SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy FROM {SCORED}", "accuracy")
C.add("accuracy_weighted", lambda s, d: met.accuracy(scored(s, d), "y", "p", F.col("q")), f"SELECT sum(CASE WHEN y = p THEN q ELSE 0.0 END) / sum(q) AS accuracy FROM {SCORED}", "accuracy")
C.add("confusion_matrix", lambda s, d: met.confusion(scored(s, d), "label", "guess"), f"SELECT label AS y, guess AS p, count(*) AS n FROM {SCORED} GROUP BY 1, 2")
_PC = f"""(SELECT label, tp, fp, fn, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2*tp + fp + fn > 0 THEN 2*tp / (2*tp + fp + fn) ELSE 0 END AS f1 FROM (
  SELECT l AS label, count(*) FILTER (label = l AND guess = l) AS tp, count(*) FILTER (label <> l AND guess = l) AS fp, count(*) FILTER (label = l AND guess <> l) AS fn
  FROM {SCORED}, (SELECT unnest(['A', 'N', 'R']) AS l) GROUP BY l))"""
C.add("classification_report", lambda s, d: met.per_class(scored(s, d), "label", "guess"), f"SELECT * FROM {_PC}", "precision recall f1")
C.add("precision_recall_f1_averages", lambda s, d: met.averaged(scored(s, d), "label", "guess"),
      f"""SELECT 'macro' AS average, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM {_PC}
      UNION ALL SELECT 'weighted', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support) FROM {_PC}
      UNION ALL SELECT 'micro', sum(tp)/(sum(tp)+sum(fp)), sum(tp)/(sum(tp)+sum(fn)), 2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)) FROM {_PC}
      UNION ALL SELECT 'binary', precision, recall, f1 FROM {_PC} WHERE label = 'R'""", "precision recall f1")
C.add("balanced_accuracy", lambda s, d: met.balanced_accuracy(scored(s, d), "label", "guess"), f"SELECT avg(recall) AS balanced_accuracy FROM {_PC}", "balanced_accuracy")
C.add("cohen_kappa", lambda s, d: met.cohen_kappa(scored(s, d), "label", "guess"),
      f"""WITH n AS (SELECT count(*)::DOUBLE AS n FROM {SCORED}), po AS (SELECT sum(tp) AS t FROM {_PC}), pe AS (SELECT sum((tp+fn)::DOUBLE*(tp+fp)) AS e FROM {_PC})
      SELECT (t/n - e/(n*n)) / (1 - e/(n*n)) AS kappa FROM n, po, pe""", "kappa")
C.add("matthews_corrcoef", lambda s, d: met.matthews(scored(s, d), "label", "guess"),
      f"""WITH m AS (SELECT sum(tp)::DOUBLE c, sum(tp+fn)::DOUBLE s, sum((tp+fn)::DOUBLE*(tp+fp)) tq, sum((tp+fp)::DOUBLE*(tp+fp)) qq, sum((tp+fn)::DOUBLE*(tp+fn)) tt FROM {_PC})
      SELECT (c*s - tq) / sqrt((s*s-qq)*(s*s-tt)) AS mcc FROM m""", "mcc")
C.add("log_loss", lambda s, d: met.log_loss(scored(s, d), "y", "score"),
      f"SELECT -avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) AS log_loss FROM (SELECT y, least(greatest(score, 1e-15), 1 - 1e-15) AS q FROM {SCORED})", "log_loss")
C.add("brier_score", lambda s, d: met.brier(scored(s, d), "y", "score"), f"SELECT avg((score - y) * (score - y)) AS brier FROM {SCORED}", "brier")
C.add("hinge_loss", lambda s, d: met.hinge(scored(s, d), "y", "score"), f"SELECT avg(greatest(0.0, 1 - (2*y - 1) * score)) AS hinge FROM {SCORED}", "hinge")
_STEPS = f"""(SELECT t AS threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS pa, sum(neg) OVER () AS na FROM
  (SELECT q AS t, sum(y) AS pos, sum(1 - y) AS neg FROM {SCORED} GROUP BY q) WINDOW w AS (ORDER BY t DESC))"""
C.add("roc_curve", lambda s, d: met.roc_curve(scored(s, d), "y", "q"), f"SELECT threshold, tp / pa AS tpr, fp / na AS fpr FROM {_STEPS}", "threshold tpr fpr")
C.add("roc_auc", lambda s, d: met.roc_auc(scored(s, d), "y", "q"), f"SELECT sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM {_STEPS}", "roc_auc")
C.add("precision_recall_curve", lambda s, d: met.precision_recall_curve(scored(s, d), "y", "q"), f"SELECT threshold, tp / (tp + fp) AS precision, tp / pa AS recall FROM {_STEPS}", "threshold precision recall")
C.add("average_precision", lambda s, d: met.average_precision(scored(s, d), "y", "q"), f"SELECT sum(pos * tp / (tp + fp)) / sum(pos) AS average_precision FROM {_STEPS}", "average_precision")
C.add("calibration_curve", lambda s, d: met.calibration_curve(scored(s, d), "y", "tax", 5).withColumn("bin", F.col("bin").cast("long")),
      f"SELECT least(floor(tax * 5), 4) AS bin, avg(y) AS prob_true, avg(tax) AS prob_pred FROM {SCORED} GROUP BY 1", "prob_true prob_pred", "bin")
C.add("expected_calibration_error", lambda s, d: met.expected_calibration_error(scored(s, d), "y", "score"),
      f"""SELECT sum(n * abs(c - a)) / sum(n) AS ece FROM (SELECT greatest(ceil(conf * 10) - 1, 0) AS b, count(*) AS n, avg(conf) AS c, avg(CASE WHEN y = CASE WHEN score >= 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END) AS a
      FROM (SELECT y, score, greatest(score, 1 - score) AS conf FROM {SCORED}) GROUP BY 1)""", "ece")
C.add("regression_metrics", lambda s, d: met.regression(scored(s, d).withColumn("pr", F.col("q") * 1500.0), "price", "pr"),
      f"""WITH e AS (SELECT price AS y, price - q * 1500.0 AS e FROM {SCORED}), m AS (SELECT avg(y) AS mu FROM e)
      SELECT avg(e*e) AS mse, sqrt(avg(e*e)) AS rmse, avg(abs(e)) AS mae, median(abs(e)) AS median_ae, max(abs(e)) AS max_error, avg(abs(e) / greatest(abs(y), 2.220446049250313e-16)) AS mape,
      avg(greatest(0.5*e, -0.5*e)) AS pinball, 1 - sum(e*e) / sum((y-mu)*(y-mu)) AS r2, 1 - var_pop(e) / var_pop(y) AS explained_variance FROM e, m""",
      "mse rmse mae median_ae max_error mape pinball r2 explained_variance", digits=3)
C.add("poisson_gamma_deviance", lambda s, d: met.deviances(scored(s, d).withColumn("pr", F.col("price") / 1500.0), "q", "pr"),
      f"SELECT avg(2*(y*ln(y/b) - y + b)) AS poisson, avg(2*(ln(b/y) + y/b - 1)) AS gamma FROM (SELECT q AS y, price/1500.0 AS b FROM {SCORED})", "poisson gamma")
_AG = f"""WITH c AS (SELECT label AS y, guess AS p, count(*)::DOUBLE AS n FROM {SCORED} GROUP BY 1, 2), t AS (SELECT sum(n) AS nn FROM c),
  ra AS (SELECT y, sum(n) AS a FROM c GROUP BY 1), rb AS (SELECT p, sum(n) AS b FROM c GROUP BY 1),
  j AS (SELECT sum(n*(n-1)/2) AS ij, sum(n/nn*ln(n*nn/(a*b))) AS mi FROM c JOIN ra USING (y) JOIN rb USING (p), t),
  ha AS (SELECT sum(a*(a-1)/2) AS pa, -sum(a/nn*ln(a/nn)) AS h1 FROM ra, t), hb AS (SELECT sum(b*(b-1)/2) AS pb, -sum(b/nn*ln(b/nn)) AS h2 FROM rb, t)
  SELECT (ij - pa*pb/(nn*(nn-1)/2)) / ((pa+pb)/2 - pa*pb/(nn*(nn-1)/2)) AS adjusted_rand, ij/sqrt(pa*pb) AS fowlkes_mallows, mi AS mutual_info, mi/((h1+h2)/2) AS normalized_mutual_info,
  mi/h1 AS homogeneity, mi/h2 AS completeness, 2*(mi/h1)*(mi/h2)/(mi/h1+mi/h2) AS v_measure FROM j, ha, hb, t"""
C.add("clustering_agreement", lambda s, d: met.clustering_agreement(scored(s, d), "label", "guess"), _AG,
      "adjusted_rand fowlkes_mallows mutual_info normalized_mutual_info homogeneity completeness v_measure")
C.add("cluster_dispersion", lambda s, d: met.dispersion(scored(s, d), "label", ["q", "disc"]),
      f"""WITH k AS (SELECT label, count(*) AS n, avg(q) AS a, avg(disc) AS b FROM {SCORED} GROUP BY 1), m AS (SELECT count(*) AS nn, avg(q) AS ma, avg(disc) AS mb FROM {SCORED}),
      w AS (SELECT s.label, sum((q-a)*(q-a)+(disc-b)*(disc-b)) AS w, avg(sqrt((q-a)*(q-a)+(disc-b)*(disc-b))) AS s FROM {SCORED} s JOIN k ON s.label=k.label GROUP BY 1),
      t AS (SELECT * FROM k JOIN w USING (label), m)
      SELECT (SELECT (sum(n*((a-ma)*(a-ma)+(b-mb)*(b-mb)))/(count(*)-1))/(sum(w)/(max(nn)-count(*))) FROM t) AS calinski_harabasz,
      (SELECT avg(r) FROM (SELECT x.label, max((x.s+z.s)/sqrt((x.a-z.a)*(x.a-z.a)+(x.b-z.b)*(x.b-z.b))) AS r FROM t x JOIN t z ON x.label<>z.label GROUP BY 1)) AS davies_bouldin""",
      "calinski_harabasz davies_bouldin", digits=4)
C.add("top_k_accuracy", lambda s, d: met.top_k_accuracy(scored(s, d).withColumn("k", F.expr("CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END")), F.col("k"), F.array("disc", "tax", F.col("q") / 500)),
      f"""SELECT avg(CASE WHEN (CASE label WHEN 'A' THEN ra WHEN 'N' THEN rn ELSE rr END) <= 2 THEN 1.0 ELSE 0.0 END) AS top_k_accuracy FROM (SELECT label,
      1 + (CASE WHEN tax > disc THEN 1 ELSE 0 END) + (CASE WHEN q/500 > disc THEN 1 ELSE 0 END) AS ra, 1 + (CASE WHEN disc >= tax THEN 1 ELSE 0 END) + (CASE WHEN q/500 > tax THEN 1 ELSE 0 END) AS rn,
      1 + (CASE WHEN disc >= q/500 THEN 1 ELSE 0 END) + (CASE WHEN tax >= q/500 THEN 1 ELSE 0 END) AS rr FROM {SCORED})""", "top_k_accuracy")

_REL = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END"
_RANK = f"(SELECT user_id AS qry, event_id AS item, {_REL} AS rel, value AS sc FROM events)"


def _rank(s, d):
    return table(s, d, "events").selectExpr("user_id AS qry", "event_id AS item", f"{_REL} AS rel", "value AS sc")


_PQ = f"""(WITH r AS (SELECT *, row_number() OVER (PARTITION BY qry ORDER BY sc DESC, item) AS k, row_number() OVER (PARTITION BY qry ORDER BY rel DESC, item) AS i FROM {_RANK}),
  h AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qry ORDER BY k) AS hits FROM r)
  SELECT qry, sum(CASE WHEN k <= 3 THEN rel / log2(k + 1) ELSE 0 END) AS dcg,
  CASE WHEN sum(CASE WHEN i <= 3 THEN rel / log2(i + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN k <= 3 THEN rel / log2(k + 1) ELSE 0 END) / sum(CASE WHEN i <= 3 THEN rel / log2(i + 1) ELSE 0 END) ELSE 0 END AS ndcg,
  CASE WHEN max(rel) > 0 THEN sum(CASE WHEN rel > 0 THEN hits / k ELSE 0 END) / sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) ELSE 0 END AS average_precision,
  coalesce(1 / min(CASE WHEN rel > 0 THEN k END), 0) AS reciprocal_rank, max(CASE WHEN rel > 0 AND k <= 3 THEN 1 ELSE 0 END) AS hit FROM h GROUP BY qry)"""
C.add("ranking_per_query", lambda s, d: met.ranking(_rank(s, d), "qry", "rel", "sc", "item", 3), f"SELECT * FROM {_PQ}", "dcg ndcg average_precision reciprocal_rank")
C.add("ranking_means", lambda s, d: met.ranking_means(met.ranking(_rank(s, d), "qry", "rel", "sc", "item", 3)),
      f"SELECT avg(ndcg) AS ndcg, avg(average_precision) AS map, avg(reciprocal_rank) AS mrr, avg(hit) AS hit_rate FROM {_PQ}", "ndcg map mrr hit_rate")

_FR = f"(SELECT g, avg(p) AS selection_rate, avg(CASE WHEN y = 1 THEN p END) AS tpr, avg(CASE WHEN y = 0 THEN p END) AS fpr, avg(CASE WHEN p = 1 THEN y END) AS ppv FROM {SCORED} GROUP BY g)"
C.add("fairness_group_rates", lambda s, d: met.group_rates(scored(s, d), "y", "p", "g"), f"SELECT * FROM {_FR}", "selection_rate tpr fpr ppv")
C.add("fairness_gaps", lambda s, d: met.fairness(scored(s, d), "y", "p", "g"),
      f"""SELECT max(selection_rate)-min(selection_rate) AS demographic_parity_difference, min(selection_rate)/max(selection_rate) AS disparate_impact_ratio, max(tpr)-min(tpr) AS equal_opportunity_difference,
      greatest(max(tpr)-min(tpr), max(fpr)-min(fpr)) AS equalized_odds_difference, max(ppv)-min(ppv) AS predictive_parity_difference FROM {_FR}""",
      "demographic_parity_difference disparate_impact_ratio equal_opportunity_difference equalized_odds_difference predictive_parity_difference")
C.add("fairness_reweighing", lambda s, d: met.reweighing(scored(s, d), "y", "g").select("id", "weight"),
      f"SELECT id, (count(*) OVER (PARTITION BY g) * count(*) OVER (PARTITION BY y)) / (count(*) OVER (PARTITION BY g, y)::DOUBLE * count(*) OVER ()) AS weight FROM {SCORED}", "weight")

# Selection and splits.
C.add("f_classif", lambda s, d: sel.f_classif(scored(s, d), "label", NUM).drop("p"),
      " UNION ALL ".join(f"""SELECT '{c}' AS feature, ((q2 - s1*s1/nn)/(k-1))/(w/(nn-k)) AS f FROM (SELECT sum(n) AS nn, count(*) AS k, sum(n*v) AS w, sum(n*m*m) AS q2, sum(n*m) AS s1
      FROM (SELECT label, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM {SCORED} GROUP BY 1))""" for c in NUM), "f", digits=4)
C.add("f_regression", lambda s, d: sel.f_regression(scored(s, d), "price", ["q", "disc", "tax"]).drop("p"),
      " UNION ALL ".join(f"SELECT '{c}' AS feature, r*r/(1-r*r)*(n-2) AS f FROM (SELECT corr({c}, price) AS r, count(*) AS n FROM {SCORED})" for c in ("q", "disc", "tax")), "f", digits=2)
C.add("chi2_features", lambda s, d: sel.chi2(scored(s, d), "label", ["q", "disc", "tax"]).drop("p"),
      " UNION ALL ".join(f"""SELECT '{c}' AS feature, sum((o-e)*(o-e)/e) AS chi2 FROM (SELECT o, sum(o) OVER () * n / sum(n) OVER () AS e FROM (SELECT label, sum({c}) AS o, count(*) AS n FROM {SCORED} GROUP BY 1))""" for c in ("q", "disc", "tax")), "chi2")
C.add("feature_p_values", lambda s, d: sel.f_classif(scored(s, d), "label", NUM))
C.add("variance_threshold", lambda s, d: s.createDataFrame([(c,) for c in pre.variance_threshold(scored(s, d), NUM, 0.001)], "feature string"),
      " UNION ALL ".join(f"SELECT '{c}' AS feature FROM {SCORED} HAVING var_pop({c}) > 0.001" for c in NUM))
C.add("select_k_best", lambda s, d: s.createDataFrame([(c,) for c in sel.select_k_best(sel.f_classif(scored(s, d), "label", NUM), "f", 2)], "feature string"),
      "SELECT feature FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS feature, ((q2 - s1*s1/nn)/(k-1))/(w/(nn-k)) AS f FROM (SELECT sum(n) AS nn, count(*) AS k, sum(n*v) AS w, sum(n*m*m) AS q2, sum(n*m) AS s1
      FROM (SELECT label, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM {SCORED} GROUP BY 1))""" for c in NUM) + ") ORDER BY f DESC LIMIT 2")
C.add("train_test_split", lambda s, d: sel.train_test_split(scored(s, d), ["id"]).select("id", "is_test"),
      f"SELECT id, row_number() OVER (ORDER BY id) - 1 < ceil(count(*) OVER () * 0.25) AS is_test FROM {SCORED}")
C.add("train_test_split_stratified", lambda s, d: sel.train_test_split(scored(s, d), ["id"], 0.2, "label").select("id", "is_test"),
      f"SELECT id, row_number() OVER (PARTITION BY label ORDER BY id) - 1 < ceil(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM {SCORED}")
C.add("k_fold", lambda s, d: sel.k_fold(scored(s, d), ["id"], 7).select("id", F.col("fold").cast("long").alias("fold")),
      f"""SELECT id, CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE n % 7 + (r - (n % 7) * (n // 7 + 1)) // (n // 7) END AS fold
      FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM {SCORED})""", "", "fold")
C.add("stratified_k_fold", lambda s, d: sel.stratified_k_fold(scored(s, d), ["id"], "label").select("id", F.col("fold").cast("long").alias("fold")),
      f"SELECT id, (row_number() OVER (PARTITION BY label ORDER BY id) - 1) % 5 AS fold FROM {SCORED}", "", "fold")
C.add("group_k_fold", lambda s, d: sel.group_k_fold(table(s, d, "customer"), "c_nationkey", 3).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.sum("c_nationkey").alias("keys")),
      """WITH RECURSIVE g AS MATERIALIZED (SELECT c_nationkey AS k, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS i FROM customer GROUP BY 1),
      r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(-1 AS BIGINT) AS fold, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k
      UNION ALL SELECT g.i, CASE WHEN f = 0 THEN a + g.n ELSE a END, CASE WHEN f = 1 THEN b + g.n ELSE b END, CASE WHEN f = 2 THEN c + g.n ELSE c END, f, g.n, g.k FROM (SELECT *, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS f FROM r) x JOIN g ON g.i = x.i + 1)
      SELECT fold, sum(n) AS n, sum(n * k) AS keys FROM r WHERE fold >= 0 GROUP BY 1""", "", "n keys")
C.add("time_series_split", lambda s, d: sel.time_series_split(table(s, d, "orders"), ["o_orderdate", "o_orderkey"], 3).groupBy("split", "part").count().withColumn("split", F.col("split").cast("long")),
      """WITH r AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS a, count(*) OVER () AS n, count(*) OVER () // 4 AS z FROM orders),
      x AS (SELECT a, n - z * 3 + k * z AS b, z, k AS split FROM r, (SELECT unnest([0, 1, 2]) AS k))
      SELECT split, CASE WHEN a < b THEN 'train' ELSE 'test' END AS part, count(*) AS count FROM x WHERE a < b + z GROUP BY 1, 2""", "", "split count")
C.add("shuffle_split", lambda s, d: sel.shuffle_split(table(s, d, "orders"), "o_orderkey").groupBy("split", "is_test").count().withColumn("split", F.col("split").cast("long")),
      "SELECT k AS split, t AS is_test, CASE WHEN t THEN ceil(n * 0.1) ELSE n - ceil(n * 0.1) END AS count FROM (SELECT count(*) AS n FROM orders), (SELECT unnest([0, 1, 2]) AS k), (SELECT unnest([true, false]) AS t)", "", "split count")
C.add("under_sampler", lambda s, d: sel.under_sample(scored(s, d), "label", ["id"]).select("id", "label"),
      f"SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM {SCORED}), (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM {SCORED} GROUP BY label)) WHERE r <= m")
C.add("over_sampler", lambda s, d: sel.over_sample(scored(s, d), "label", ["id"]).groupBy("label").count(),
      f"SELECT label, m AS count FROM (SELECT DISTINCT label FROM {SCORED}), (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM {SCORED} GROUP BY label))")
C.add("goss_sample", lambda s, d: sel.goss(scored(s, d).withColumn("gr", F.col("disc") - F.col("tax")), "gr", "id").groupBy("weight").count(),
      f"WITH n AS (SELECT count(*) AS n FROM {SCORED}) SELECT 1.0 AS weight, floor(n * 0.2) AS count FROM n UNION ALL SELECT 8.0, floor(n * 0.1) FROM n", "weight", "count")
