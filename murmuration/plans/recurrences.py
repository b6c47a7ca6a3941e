"""Recurrences as prefix scans over events by type, and their recursive DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recurrence as rc
from .inputs import Catalog
from .streams import ev

C = Catalog()
_ORDER, _BY = ["ts", "event_id"], ["event_type"]


def _uneven(s, d):
    """Events whose values are no short decimals: no rounding meets a tie."""
    return ev(s, d).withColumn("value", F.col("value") / 3.7)


def _recursive(start: str, step: str, state: str, given: str, first: str = "") -> str:
    """One row of each type after another: `start` reads x1, x2 and xs (a type's first values, in order)."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, event_type AS k, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
      f AS (SELECT k, list(x ORDER BY i) AS xs FROM e WHERE i <= 16 GROUP BY k), r AS (SELECT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS x, {start} FROM f {first}
      UNION ALL SELECT k, i, event_id, x, {state} FROM (SELECT r.* EXCLUDE (i, event_id, x), e.i, e.event_id, e.x, {step} FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1))
      SELECT event_id, {given} FROM r WHERE event_id IS NOT NULL"""


C.add("holt_trend", lambda s, d: rc.holt(ev(s, d), "value", _ORDER, _BY).select("event_id", "fitted", "level", "trend"), _recursive(
    "xs[1] AS l, xs[2] - xs[1] AS b, 0.0::DOUBLE AS fit", "l + b AS f1, 0.3 * e.x + 0.7 * (l + b) AS l1, 0.1 * (l1 - l) + 0.9 * b AS b1", "l1 AS l, b1 AS b, f1 AS fit",
    "fit AS fitted, l AS level, b AS trend"), "fitted level trend")
C.add("damped_trend", lambda s, d: rc.holt(ev(s, d), "value", _ORDER, _BY, 0.4, 0.2, 0.9).select("event_id", "fitted", "level", "trend"), _recursive(
    "xs[1] AS l, xs[2] - xs[1] AS b, 0.0::DOUBLE AS fit", "l + 0.9 * b AS f1, 0.4 * e.x + 0.6 * (l + 0.9 * b) AS l1, 0.2 * (l1 - l) + 0.8 * 0.9 * b AS b1", "l1 AS l, b1 AS b, f1 AS fit",
    "fit AS fitted, l AS level, b AS trend"), "fitted level trend")
_SEASONS = _recursive(
    "list_sum(xs[1:6]) / 6 AS l, (list_sum(xs[7:12]) - list_sum(xs[1:6])) / 36 AS b, list_transform(xs[1:6], lambda v: v - list_sum(xs[1:6]) / 6) AS s, 0.0::DOUBLE AS fit",
    "l + b + s[1] AS f1, 0.3 * (e.x - s[1]) + 0.7 * (l + b) AS l1, 0.1 * (l1 - l) + 0.9 * b AS b1, list_append(s[2:6], 0.1 * (e.x - l1) + 0.9 * s[1]) AS s1",
    "l1 AS l, b1 AS b, s1 AS s, f1 AS fit", "fit AS fitted, l AS level, b AS trend, s[6] AS seasonal", "WHERE len(xs) >= 12").replace("value AS x", "value / 3.7 AS x")
C.add("holt_winters", lambda s, d: rc.holt_winters(_uneven(s, d), "value", _ORDER, _BY, 6).select("event_id", "fitted", "level", "trend", "seasonal"), _SEASONS, "fitted level trend seasonal")
C.add("seasonal_forecast", lambda s, d: rc.forecast(rc.holt_winters(_uneven(s, d), "value", _ORDER, _BY, 6), _ORDER, _BY, 9),
      f"""SELECT event_type, h AS step, l + h * b + s[(h - 1) % 6 + 1] AS forecast FROM ({_SEASONS.replace("SELECT event_id, fit AS fitted, l AS level, b AS trend, s[6] AS seasonal FROM r", "SELECT k AS event_type, arg_max(l, i) AS l, arg_max(b, i) AS b, arg_max(s, i) AS s FROM r")} GROUP BY k), (SELECT unnest(range(1, 10)) AS h)""", "forecast", "step")
C.add("arma_residuals", lambda s, d: rc.arma_residuals(ev(s, d).withColumn("value", F.col("value") - 50), "value", _ORDER, _BY, [0.5, -0.2], [0.3]).select("event_id", "resid"), _recursive(
    "0.0::DOUBLE AS e1, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2", "(e.x - 50) - 0.5 * x1 + 0.2 * x2 - 0.3 * e1 AS r1", "r1 AS e1, x - 50 AS x1, x1 AS x2", "e1 AS resid"), "resid")
C.add("autoregression", lambda s, d: rc.autoregression(ev(s, d), "value", _ORDER, _BY, 2).select("event_type", "mean", F.col("coefficients")[0].alias("c1"), F.col("coefficients")[1].alias("c2"), "sigma2", "n"),
      """WITH c AS (SELECT event_type, ts, event_id, value - avg(value) OVER (PARTITION BY event_type) AS y, avg(value) OVER (PARTITION BY event_type) AS mean FROM events WHERE value IS NOT NULL),
      l AS (SELECT *, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
      q AS (SELECT event_type, any_value(mean) AS mean, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS ay2 FROM l WHERE b IS NOT NULL GROUP BY 1),
      w AS (SELECT *, (ay * bb - ay2 * ab) / (aa * bb - ab * ab) AS c1, (ay2 * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM q)
      SELECT w.event_type, w.mean, c1, c2, w.n, var_pop(y - c1 * a - c2 * b) AS sigma2 FROM w JOIN l USING (event_type) WHERE b IS NOT NULL GROUP BY ALL""", "mean c1 c2 sigma2", "n")
C.add("kalman_trend", lambda s, d: rc.kalman_filter(ev(s, d), ["value"], _ORDER, _BY, [[1, 1], [0, 1]], [[1, 0]], [[1, 0], [0, 0.01]], 10.0).select("event_id", F.col("mean")[0].alias("level"), F.col("mean")[1].alias("slope"), F.col("covariance")[0].alias("spread")), _recursive(
    "0.0::DOUBLE AS l, 0.0::DOUBLE AS b, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 1.0::DOUBLE AS p22",
    "p11 + 2 * p12 + p22 + 1 AS q11, p12 + p22 AS q12, p22 + 0.01 AS q22, q11 / (q11 + 10) AS k1, q12 / (q11 + 10) AS k2, e.x - l - b AS innovation",
    "l + b + k1 * innovation AS l, b + k2 * innovation AS b, (1 - k1) * q11 AS p11, (1 - k1) * q12 AS p12, q22 - k2 * q12 AS p22", "l AS level, b AS slope, p11 AS spread"), "level slope spread")
