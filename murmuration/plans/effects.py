"""Treatment effects and validated fits over line items, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects as ef
from .inputs import SCORED, Catalog, scored

C = Catalog()
# A treatment that helps more the larger the quantity.
_ROWS = f"(SELECT id, q, disc, CASE WHEN label = 'R' THEN 1 ELSE 0 END AS t, q * 2 + disc * 10 + CASE WHEN label = 'R' THEN 3 + q / 10 ELSE 0 END + id % 7 AS o FROM {SCORED})"
_FOLD = "floor(CAST('0x' || substr(md5('fold:' || id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * 2)"


def _rows(s, d):
    t = F.when(F.col("label") == "R", 1).otherwise(0)
    return scored(s, d).select("id", "q", "disc", t.alias("t"), (F.col("q") * 2 + F.col("disc") * 10 + F.when(F.col("label") == "R", 3 + F.col("q") / 10).otherwise(0) + F.col("id") % 7).alias("o"))


C.add("t_learner", lambda s, d: _rows(s, d).select("q", ef.t_learner(_rows(s, d), "t", "o", ["q"]).alias("effect")).distinct(),
      f"SELECT q, a + b * q AS effect FROM (SELECT DISTINCT q FROM {_ROWS}), (SELECT regr_intercept(o, q) FILTER (t = 1) - regr_intercept(o, q) FILTER (t = 0) AS a, regr_slope(o, q) FILTER (t = 1) - regr_slope(o, q) FILTER (t = 0) AS b FROM {_ROWS})", "effect")
C.add("x_learner", lambda s, d: _rows(s, d).select("q", ef.x_learner(_rows(s, d), "t", "o", ["q"]).alias("effect")).distinct(),
      f"""WITH f AS (SELECT regr_intercept(o, q) FILTER (t = 1) AS a1, regr_slope(o, q) FILTER (t = 1) AS b1, regr_intercept(o, q) FILTER (t = 0) AS a0, regr_slope(o, q) FILTER (t = 0) AS b0, avg(t) AS e FROM {_ROWS}),
      g AS (SELECT q, t, e, CASE WHEN t = 1 THEN o - a0 - b0 * q ELSE a1 + b1 * q - o END AS g FROM {_ROWS}, f),
      h AS (SELECT regr_intercept(g, q) FILTER (t = 1) AS a1, regr_slope(g, q) FILTER (t = 1) AS b1, regr_intercept(g, q) FILTER (t = 0) AS a0, regr_slope(g, q) FILTER (t = 0) AS b0, any_value(e) AS e FROM g)
      SELECT q, e * (a0 + b0 * q) + (1 - e) * (a1 + b1 * q) AS effect FROM (SELECT DISTINCT q FROM {_ROWS}), h""", "effect")
C.add("double_ml", lambda s, d: ef.double_ml(_rows(s, d), "t", "o", ["q"], "id", 2),
      f"""WITH r AS MATERIALIZED (SELECT *, {_FOLD} AS k FROM {_ROWS}), f AS (SELECT k, regr_intercept(t, q) AS ta, regr_slope(t, q) AS tb, regr_intercept(o, q) AS oa, regr_slope(o, q) AS ob FROM r GROUP BY k),
      l AS (SELECT t - ta - tb * q AS t, o - oa - ob * q AS y FROM r JOIN f ON f.k = 1 - r.k), e AS (SELECT sum(t * y) / sum(t * t) AS effect, sum(t * t) AS tt FROM l)
      SELECT any_value(effect) AS effect, sqrt(sum(t * t * power(y - effect * t, 2))) / any_value(tt) AS se, count(*) AS n FROM l, e""", "effect se")
_CV = f"""WITH r AS MATERIALIZED (SELECT *, {_FOLD} AS k FROM {_ROWS}), f AS (SELECT k, a, covar_pop(q, o) * count(*) / (var_pop(q) * count(*) + a) AS b, avg(o) AS my, avg(q) AS mx FROM r, (SELECT unnest([0.0, 1000.0, 1000000.0]) AS a) GROUP BY k, a)
      SELECT a AS alpha, avg(power(o - my - b * (q - mx), 2)) AS mse FROM r JOIN f ON f.k = 1 - r.k GROUP BY a"""
C.add("ridge_cv", lambda s, d: ef.ridge_cv(_rows(s, d), ["q"], "o", [0.0, 1000.0, 1000000.0], "id", 2)[1], _CV, "alpha mse")


def _huber_sql(rounds: int) -> str:
    steps = [f"d AS MATERIALIZED (SELECT q AS x, o + CASE WHEN id % 50 = 0 THEN 500 ELSE 0 END AS y FROM {_ROWS})", "f0 AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM d)"]
    for i in range(rounds):
        steps.append(f"s{i} AS MATERIALIZED (SELECT avg(abs(y - a - b * x)) / 0.7978845608028654 * 1.35 AS h, any_value(a) AS a, any_value(b) AS b FROM d, f{i})")
        steps.append(f"w{i} AS MATERIALIZED (SELECT x, y, CASE WHEN abs(y - a - b * x) <= h THEN 1 ELSE h / abs(y - a - b * x) END AS w FROM d, s{i})")
        steps.append(f"f{i + 1} AS MATERIALIZED (SELECT (sum(w * y) - b * sum(w * x)) / sum(w) AS a, b FROM w{i}, (SELECT (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - power(sum(w * x), 2)) AS b FROM w{i}) GROUP BY b)")
    return f"WITH {', '.join(steps)} SELECT a AS intercept, b AS slope FROM f{rounds}"


def _huber(s, d):
    rows = _rows(s, d).withColumn("y", F.col("o") + F.when(F.col("id") % 50 == 0, 500).otherwise(0))
    fit = ef.huber(rows, ["q"], "y", rounds=4, tol=0.0)
    return s.createDataFrame([(float(fit.intercept), float(fit.coefficients[0]))], "intercept double, slope double")


C.add("huber_regression", _huber, _huber_sql(4), "intercept slope", digits=5)
