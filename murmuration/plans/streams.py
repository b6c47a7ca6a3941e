"""Streaming operators in their batch form over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recurrence as rc
from ..session import table
from ..streaming import online
from .inputs import Catalog

C = Catalog()


def ev(s, d):
    return table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


C.add("tumbling_windows", lambda s, d: online.windowed(ev(s, d), "ts", "event_type", "value", "6 hours"),
      "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS total, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) / count(value) AS mean FROM events GROUP BY 1, 2", "total mean", digits=8)
C.add("session_windows", lambda s, d: online.sessions(ev(s, d), "ts", "user_id", "2 hours"),
      """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, k""")


def _fold(start: str, step: str, state: str, flag: str, source: str = "events", value: str = "value") -> str:
    """A fold over each event type in order of time: `step` makes the new values, `state` what is kept, `flag` what is given."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, event_type AS k, {value} AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM {source}),
      r AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, {start}, {flag[1]} AS flag FROM e
      UNION ALL SELECT k, i, event_id, {state}, f AS flag FROM (SELECT r.* EXCLUDE (i, event_id, flag), e.i, e.event_id, e.x, {step}, {flag[0]} AS f FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1))
      SELECT event_id, flag FROM r WHERE event_id IS NOT NULL"""


def _detected(detector, value="value"):
    def run(s, d):
        e = ev(s, d).selectExpr("event_id", "ts", "event_type", f"{value} AS x")
        return online.detect(e, detector, "event_type", "x", ["ts", "event_id"]).select("event_id", "flag")

    return run


_NEW = "CASE WHEN f THEN {zero} ELSE {new} END AS {name}"


def _reset(**names: str) -> str:
    """State that starts anew after a flag: name=zero, the new value is name1."""
    return ", ".join(_NEW.format(zero=zero, new=f"{name}1", name=name) for name, zero in names.items())


_WRONG = "CASE WHEN value > 80 THEN 1.0 ELSE 0.0 END"
C.add("page_hinkley", _detected(online.PageHinkley(threshold=150.0)), _fold(
    "CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS low",
    "n + 1 AS n1, mean + (x - mean) / (n + 1) AS mean1, total + x - mean1 - 0.005 AS total1, least(low, total1) AS low1",
    _reset(n="0", mean="0", total="0", low="0"), ("n1 >= 30 AND total1 - low1 > 150", "false")))
C.add("online_smoothing", lambda s, d: rc.simple_smoothing(ev(s, d), "value", ["ts", "event_id"], ["event_type"]).select("event_id", (F.abs(F.col("value") - F.col("fitted")) > 100).alias("flag")), _fold(
    "CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS level", "n + 1 AS n1, CASE WHEN n = 0 THEN x ELSE 0.3 * x + 0.7 * level END AS level1",
    "n1 AS n, level1 AS level", ("n > 0 AND abs(x - level) > 100", "false")))
C.add("error_rate_drift", _detected(online.ErrorRate(), "CASE WHEN value > 80 THEN 1.0D ELSE 0.0D END"), _fold(
    "CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS p, CAST('inf' AS DOUBLE) AS bp, CAST('inf' AS DOUBLE) AS bs",
    "n + 1 AS n1, p + (x - p) / (n + 1) AS p1, sqrt(p1 * (1 - p1) / n1) AS s1, n1 >= 30 AND p1 + s1 < bp + bs AS better, CASE WHEN better THEN p1 ELSE bp END AS bp1, CASE WHEN better THEN s1 ELSE bs END AS bs1",
    _reset(n="0", p="0", bp="CAST('inf' AS DOUBLE)", bs="CAST('inf' AS DOUBLE)"), ("n1 >= 30 AND p1 + s1 > bp1 + 3 * bs1", "false"), value=f"CAST({_WRONG} AS DOUBLE)"))
C.add("error_distance_drift", _detected(online.ErrorDistance(), "CASE WHEN value > 80 THEN 1.0D ELSE 0.0D END"), _fold(
    "CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS er, CAST(0 AS BIGINT) AS la, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS m2, CAST(0 AS DOUBLE) AS wide",
    "n + 1 AS n1, CASE WHEN x > 0 THEN er + 1 ELSE er END AS er1, CASE WHEN x > 0 THEN n1 ELSE la END AS la1, CAST(n1 - la AS DOUBLE) AS gap, CASE WHEN x > 0 THEN mean + (gap - mean) / er1 ELSE mean END AS mean1, CASE WHEN x > 0 THEN m2 + (gap - mean) * (gap - mean1) ELSE m2 END AS m21, x > 0 AND er1 >= 30 AS ready, CASE WHEN ready THEN mean1 + 2 * sqrt(greatest(m21, 0) / er1) ELSE 0 END AS sc, greatest(wide, sc) AS wide1",
    _reset(n="0", er="0", la="0", mean="0", m2="0", wide="0"), ("ready AND sc / (wide1 + 1e-12) < 0.9", "false"), value=f"CAST({_WRONG} AS DOUBLE)"))
C.add("local_level_filter", lambda s, d: rc.local_level(ev(s, d), "value", ["ts", "event_id"], ["event_type"]).select("event_id", F.col("level").alias("flag")), _fold(
    "CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS spread",
    "(spread + 1) / (spread + 11) AS gain, CASE WHEN n = 0 THEN x ELSE level + gain * (x - level) END AS level1, CASE WHEN n = 0 THEN 10 ELSE (1 - gain) * (spread + 1) END AS spread1",
    "n + 1 AS n, level1 AS level, spread1 AS spread", ("level1", "CAST(0 AS DOUBLE)")), "flag")
C.add("adaptive_coverage", lambda s, d: rc.adaptive_coverage(ev(s, d).withColumn("missed", F.col("value") > 80), "missed", ["ts", "event_id"], ["event_type"]).select("event_id", F.col("alpha").alias("flag")),
      f"SELECT event_id, 0.1 + 0.05 * sum(0.1 - {_WRONG}) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS flag FROM events", "flag")
C.add("online_moments", lambda s, d: online.moment_flags(ev(s, d), "event_type", "value", ["ts", "event_id"], 2.0).select("event_id", "flag"),
      """SELECT event_id, coalesce(n >= 30 AND abs(value - m) > 2 * sd, false) AS flag FROM (SELECT event_id, value, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
C.add("adaptive_window", _detected(online.AdaptiveWindow()))
C.add("window_test_drift", _detected(online.WindowTest()))
C.add("running_quantile", lambda s, d: _detected(online.Quantile(0.5))(s, d).join(ev(s, d), "event_id").groupBy("event_type").agg((F.abs(F.max_by("flag", F.struct("ts", "event_id")) - F.median("value")) < 0.1 * F.stddev("value")).alias("near")),
      "SELECT DISTINCT event_type, true AS near FROM events")
C.add("sparse_logistic_stream", lambda s, d: online.detect(ev(s, d).select("event_id", "ts", "event_type", F.array(F.lit(1.0), F.col("value") / 100, (F.col("value") > 50).cast("double")).alias("x")), online.SparseLogistic(), "event_type", "x", ["ts", "event_id"]).select("event_id", "flag"), _fold(
    ", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in ("z1", "n1", "z2", "n2")),
    "x / 100 AS v, CASE WHEN x > 50 THEN 1.0 ELSE 0.0 END AS y, " + ", ".join(f"CASE WHEN abs(z{i}) <= 1 THEN 0 ELSE -(z{i} - sign(z{i})) / ((1 + sqrt(n{i})) / 0.1 + 1) END AS w{i}" for i in (1, 2))
    + ", 1 / (1 + exp(-greatest(-35, least(35, w1 + w2 * v)))) AS p, p - y AS g1, (p - y) * v AS g2",
    ", ".join(f"z{i} + g{i} - (sqrt(n{i} + g{i} * g{i}) - sqrt(n{i})) / 0.1 * w{i} AS z{i}, n{i} + g{i} * g{i} AS n{i}" for i in (1, 2)), ("p", "CAST(0 AS DOUBLE)")), "flag")
C.add("gradient_descent_stream", lambda s, d: online.detect(ev(s, d).select("event_id", "ts", "event_type", F.array(F.lit(1.0), F.col("value") / 100, (F.col("value") > 50).cast("double")).alias("x")), online.GradientDescent(), "event_type", "x", ["ts", "event_id"]).select("event_id", "flag"), _fold(
    "CAST(0 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2",
    "x / 100 AS v, CASE WHEN x > 50 THEN 1.0 ELSE 0.0 END AS y, 1 / (1 + exp(-greatest(-35, least(35, w1 + w2 * v)))) AS p, 0.5 / sqrt(t + 1) AS h",
    "t + 1 AS t, w1 - h * (p - y) AS w1, w2 - h * (p - y) * v AS w2", ("p", "CAST(0 AS DOUBLE)")), "flag")
C.add("hedge", lambda s, d: online.detect(ev(s, d).select("event_id", "ts", "event_type", F.array(F.col("value") / 100, 1 - F.col("value") / 100).alias("x")), online.Hedge(), "event_type", "x", ["ts", "event_id"]).select("event_id", "flag"),
      """SELECT event_id, (x * exp(-0.5 * (a - least(a, b))) + (1 - x) * exp(-0.5 * (b - least(a, b)))) / (exp(-0.5 * (a - least(a, b))) + exp(-0.5 * (b - least(a, b)))) AS flag FROM (SELECT event_id, value / 100 AS x, coalesce(sum(value / 100) OVER w, 0) AS a, coalesce(sum(1 - value / 100) OVER w, 0) AS b
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "flag")
