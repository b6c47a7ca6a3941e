"""Queries of composed steps, cross-validation, discriminants, covariances, mixtures and power transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compose as co
from ..operators import gaussian as ga
from ..operators import linear as lin
from ..operators import preprocessing as pre
from ..operators import selection as sel
from ..session import table
from .inputs import SCORED, Catalog, scored

C = Catalog()

C.add("column_transformer", lambda s, d: (lambda df: co.side_by_side(df, [("std", pre.fit_standard, ["q"]), ("mm", pre.fit_min_max, ["disc", "tax"])], ["id"]).transform(df))(scored(s, d).select("id", "q", "disc", "tax")),
      f"""SELECT id, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS std__q, (disc - min(disc) OVER ()) / (max(disc) OVER () - min(disc) OVER ()) AS mm__disc, (tax - min(tax) OVER ()) / (max(tax) OVER () - min(tax) OVER ()) AS mm__tax FROM {SCORED}""", "std__q mm__disc mm__tax")
C.add("feature_union", lambda s, d: (lambda df: co.side_by_side(df, [("std", pre.fit_standard, ["q"]), ("abs", pre.fit_max_abs, ["q"])], ["id", "q"]).transform(df))(scored(s, d).select("id", "q")),
      f"SELECT id, q, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS std__q, q / max(abs(q)) OVER () AS abs__q FROM {SCORED}", "std__q abs__q")
C.add("pipeline_steps", lambda s, d: (lambda df: co.pipeline(df, [(pre.fit_standard, ["q"]), (pre.fit_min_max, ["q"])]).transform(df))(scored(s, d).select("id", "q")),
      f"SELECT id, (q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()) AS q FROM {SCORED}", "q")
C.add("select_by_mask", lambda s, d: (lambda df: co.from_scores(sel.f_classif(df, "label", ["q", "disc", "tax", "z"]), 1000.0, ["id"]).transform(df))(scored(s, d).select("id", "label", "q", "disc", "tax", (F.col("y") * 10 + F.col("tax")).alias("z"))),
      f"SELECT id, y * 10 + tax AS z FROM {SCORED}", "z")
C.add("function_transformer", lambda s, d: pre.function_transform(scored(s, d).select("id", "price"), {"price": F.log1p}), f"SELECT id, ln(1 + price) AS price FROM {SCORED}", "price")


def _folds(s, d):
    return scored(s, d).select("id", "y", "q", "price", "disc", F.pmod(F.col("id"), F.lit(5)).cast("int").alias("fold"))


def _ridge(alpha):
    def fit(train):
        terms = {r.term: r.coefficient for r in lin.ridge(train, ["q"], "price", alpha).table(train.sparkSession).collect()}
        return F.col("q") * terms["q"] + terms["intercept"]

    return fit


def _cv_sql(alpha):
    return f"""(WITH f AS (SELECT id % 5 AS fold, q, price FROM {SCORED}), k AS (SELECT DISTINCT fold AS k FROM f),
      m AS (SELECT k, avg(q) AS mq, avg(price) AS mp, covar_pop(price, q) * count(*) AS xy, var_pop(q) * count(*) AS xx FROM f JOIN k ON fold <> k GROUP BY k)
      SELECT CAST(fold AS INTEGER) AS fold, 1 - sum(power(price - (mp + (q - mq) * xy / (xx + {alpha})), 2)) / (var_pop(price) * count(*)) AS score FROM f JOIN m ON fold = k GROUP BY fold)"""


C.add("cross_val_score", lambda s, d: co.cross_val_score(_folds(s, d), "fold", _ridge(50.0), "price", co.SCORES["r2"]), f"SELECT * FROM {_cv_sql(50.0)}", "score")
C.add("grid_search", lambda s, d: co.grid_search(_folds(s, d), "fold", lambda alpha: _ridge(alpha), {"alpha": [0.0, 50.0, 5000.0]}, "price", co.SCORES["r2"]).select(F.col("candidate").cast("long").alias("candidate"), "mean", "sd"),
      " UNION ALL ".join(f"SELECT {i} AS candidate, avg(score) AS mean, stddev_pop(score) AS sd FROM {_cv_sql(a)}" for i, a in enumerate((0.0, 50.0, 5000.0))), "mean sd", "candidate")
C.add("cross_val_predict", lambda s, d: co.cross_val_predict(_folds(s, d), "fold", lambda t: F.lit(float(t.agg(F.avg("price")).first()[0]))).select("id", "predicted"),
      f"WITH f AS (SELECT id, id % 5 AS fold, price FROM {SCORED}), t AS (SELECT fold, sum(price) AS p, count(*) AS n FROM f GROUP BY 1) SELECT id, ((SELECT sum(p) FROM t) - p) / ((SELECT sum(n) FROM t) - n) AS predicted FROM f JOIN t USING (fold)", "predicted", digits=3)
C.add("custom_scorer", lambda s, d: co.cross_val_score(_folds(s, d), "fold", lambda t: F.lit(float(t.agg(F.avg("q")).first()[0])), "q", lambda y, p: F.max(F.abs(y - p)) / F.avg(y)),
      f"WITH f AS (SELECT id % 5 AS fold, q FROM {SCORED}), t AS (SELECT fold, sum(q) AS p, count(*) AS n FROM f GROUP BY 1), m AS (SELECT fold, ((SELECT sum(p) FROM t) - p) / ((SELECT sum(n) FROM t) - n) AS m FROM t) SELECT CAST(fold AS INTEGER) AS fold, max(abs(q - m)) / avg(q) AS score FROM f JOIN m USING (fold) GROUP BY fold", "score")
C.add("learning_curve", lambda s, d: (lambda df: co.learning_curve(df, "fold", "at", 1000, [0.25, 1.0], lambda t: F.lit(float(t.agg(F.avg("q")).first()[0])), "q", co.SCORES["mae"]))(_folds(s, d).withColumn("at", F.pmod(F.col("id") * 7919, F.lit(1000)))),
      " UNION ALL ".join(f"SELECT {a} AS share, avg(e) AS mean FROM (SELECT fold, avg(abs(q - m)) AS e FROM f JOIN (SELECT k, avg(q) AS m FROM f JOIN (SELECT DISTINCT fold AS k FROM f) ON fold <> k WHERE pl < {a} * 1000 GROUP BY k) ON fold = k GROUP BY fold)".replace(" f ", f" (SELECT id % 5 AS fold, q, (id * 7919) % 1000 AS pl FROM {SCORED}) f ").replace("FROM f)", f"FROM (SELECT id % 5 AS fold FROM {SCORED}) f)") for a in (0.25, 1.0)), "share mean")

_G = f"(SELECT label, count(*)::DOUBLE AS n, avg(q) AS mx, avg(disc) AS my, var_pop(q) AS vx, var_pop(disc) AS vy, covar_pop(q, disc) AS vz FROM {SCORED} GROUP BY 1)"
_PICK = "SELECT id, min(label) AS predicted FROM (SELECT *, max(sc) OVER (PARTITION BY id) AS top FROM z) WHERE sc >= top - 1e-12 GROUP BY 1"
_FORM = "(b * (q - mx) * (q - mx) - 2 * c * (q - mx) * (disc - my) + a * (disc - my) * (disc - my)) / (a * b - c * c)"


def _counted(column):
    return lambda s, d: (lambda df: df.select(column(df).alias("predicted")).groupBy("predicted").agg(F.count("*").alias("n")))(scored(s, d))


C.add("linear_discriminant", _counted(lambda df: ga.discriminant(df, "label", ["q", "disc"])),
      f"""WITH g AS {_G}, p AS (SELECT sum(n * vx) / (sum(n) - count(*)) + 1e-6 AS a, sum(n * vy) / (sum(n) - count(*)) + 1e-6 AS b, sum(n * vz) / (sum(n) - count(*)) AS c, sum(n) AS nn FROM g),
      z AS (SELECT id, label, ln(n / nn) - 0.5 * {_FORM} AS sc FROM (SELECT row_number() OVER () AS id, q, disc FROM {SCORED}), g, p) SELECT predicted, count(*) AS n FROM ({_PICK}) GROUP BY 1""", "", "n")
C.add("quadratic_discriminant", _counted(lambda df: ga.discriminant(df, "label", ["q", "disc"], quadratic=True)),
      f"""WITH g AS (SELECT label, n, mx, my, n / (n - 1) * vx + 1e-6 AS a, n / (n - 1) * vy + 1e-6 AS b, n / (n - 1) * vz AS c, sum(n) OVER () AS nn FROM {_G}),
      z AS (SELECT id, label, ln(n / nn) - 0.5 * ln(a * b - c * c) - 0.5 * {_FORM} AS sc FROM (SELECT row_number() OVER () AS id, q, disc FROM {SCORED}), g) SELECT predicted, count(*) AS n FROM ({_PICK}) GROUP BY 1""", "", "n")

_PQ = f"(SELECT q, price / 1000 AS p FROM {SCORED})"
_COV = f"(SELECT var_pop(q) AS x, var_pop(p) AS y, covar_pop(q, p) AS z, count(*)::DOUBLE AS n, avg(q) AS mq, avg(p) AS mp FROM {_PQ})"
_CELLS = "SELECT a, b, (1 - h) * (CASE WHEN a <> b THEN z WHEN a = 'q' THEN x ELSE y END) + h * (CASE WHEN a = b THEN (x + y) / 2 ELSE 0 END) AS cov FROM s, (SELECT unnest(['q', 'p']) AS a), (SELECT unnest(['q', 'p']) AS b)"


def _pq(s, d):
    return scored(s, d).select("q", (F.col("price") / 1000).alias("p"))


C.add("shrunk_covariance", lambda s, d: ga.covariance_table(_pq(s, d), ["q", "p"], "shrunk", 0.2), f"WITH s AS (SELECT *, 0.2 AS h FROM {_COV}) {_CELLS}", "cov", digits=4)
C.add("ledoit_wolf", lambda s, d: ga.covariance_table(_pq(s, d), ["q", "p"], "ledoit_wolf"),
      f"""WITH v AS (SELECT * FROM {_COV}), t AS (SELECT avg(power(power(q - mq, 2) + power(p - mp, 2), 2)) AS sq FROM {_PQ}, v), u AS (SELECT *, (power(x - (x + y) / 2, 2) + power(y - (x + y) / 2, 2) + 2 * z * z) / 2 AS delta, (sq - (x * x + y * y + 2 * z * z)) / (2 * n) AS beta FROM v, t),
      s AS (SELECT *, least(beta, delta) / delta AS h FROM u) {_CELLS}""", "cov", digits=4)
C.add("oas_covariance", lambda s, d: ga.covariance_table(_pq(s, d), ["q", "p"], "oas"),
      f"""WITH u AS (SELECT *, (x * x + y * y + 2 * z * z) / 4 AS al, power((x + y) / 2, 2) AS m2 FROM {_COV}), s AS (SELECT *, least((al + m2) / ((n + 1) * (al - m2 / 2)), 1) AS h FROM u) {_CELLS}""", "cov", digits=4)
C.add("weighted_least_squares", lambda s, d: ga.weighted_least_squares(scored(s, d).withColumn("w", F.col("disc") + 0.5), ["q"], "price", "w"),
      f"""WITH m AS (SELECT sum(w) AS w, sum(w*q) / sum(w) AS mx, sum(w*price) / sum(w) AS my, sum(w*q*price) / sum(w) AS xy, sum(w*q*q) / sum(w) AS xx FROM (SELECT q, price, disc + 0.5 AS w FROM {SCORED})), b AS (SELECT *, (xy - mx*my) / (xx - mx*mx) AS b FROM m)
      SELECT 'intercept' AS term, my - b * mx AS coefficient FROM b UNION ALL SELECT 'q', b FROM b""", "coefficient", digits=2)
_EM = "exp(-0.5 * (v - {m}) * (v - {m}) / {s}) * {w} / sqrt({s})"


def _em_sql(rounds):
    """Two components in one dimension, unrolled round by round."""
    steps = ["p0 AS (SELECT 0.5 AS w0, 0.5 AS w1, 20.0 AS m0, 80.0 AS m1, var_pop(value) + 1e-6 AS s0, var_pop(value) + 1e-6 AS s1 FROM events)"]
    for i in range(rounds):
        a, b = _EM.format(m="m0", s="s0", w="w0"), _EM.format(m="m1", s="s1", w="w1")
        steps.append(f"r{i} AS (SELECT v, {a} / ({a} + {b}) AS g FROM (SELECT value AS v FROM events), p{i})")
        steps.append(f"""p{i + 1} AS (SELECT sum(g) / count(*) AS w0, sum(1 - g) / count(*) AS w1, sum(g * v) / sum(g) AS m0, sum((1 - g) * v) / sum(1 - g) AS m1,
          sum(g * v * v) / sum(g) - power(sum(g * v) / sum(g), 2) + 1e-6 AS s0, sum((1 - g) * v * v) / sum(1 - g) - power(sum((1 - g) * v) / sum(1 - g), 2) + 1e-6 AS s1 FROM r{i})""")
    return f"WITH {', '.join(steps)} SELECT 0 AS component, w0 AS weight, m0 AS mean, s0 AS variance FROM p{rounds} UNION ALL SELECT 1, w1, m1, s1 FROM p{rounds}"


def _mixture(s, d):
    parts = ga.gaussian_mixture(table(s, d, "events").select("value"), ["value"], [[20.0], [80.0]], 4)
    return s.createDataFrame([(i, float(w), float(m[0]), float(v[0, 0])) for i, (w, m, v) in enumerate(parts)], "component long, weight double, mean double, variance double")


C.add("gaussian_mixture", _mixture, _em_sql(4), "weight mean variance", "component", digits=5)
C.add("yeo_johnson", lambda s, d: table(s, d, "customer").select("c_custkey", ga.yeo_johnson(F.col("c_acctbal") / 1000, 0.5).alias("v")),
      "SELECT c_custkey, CASE WHEN x >= 0 THEN (power(x + 1, 0.5) - 1) / 0.5 ELSE -(power(1 - x, 1.5) - 1) / 1.5 END AS v FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)", "v")
_POW = "CASE WHEN abs(l) < 1e-6 THEN ln(1 + x) ELSE (power(x + 1, l) - 1) / l END"
C.add("yeo_johnson_power", lambda s, d: s.createDataFrame([(ga.yeo_johnson_power(table(s, d, "events"), "value", rounds=1),)], "power double"),
      f"""SELECT l AS power FROM (SELECT l, -0.5 * count(*) * ln(var_pop({_POW}) + 1e-12) + (l - 1) * sum(sign(x) * ln(1 + abs(x))) AS ll FROM (SELECT value AS x FROM events), (SELECT -2 + 0.25 * unnest(range(0, 21)) AS l) GROUP BY l) ORDER BY ll DESC LIMIT 1""", "power")
