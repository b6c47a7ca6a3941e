"""Joins by order and likeness of names over events, customers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as mt
from ..operators import series as ts
from ..operators import strings as st
from ..session import table
from . import textual
from .inputs import Catalog

C = Catalog()


def _of_type(s, d, kind, *columns):
    return table(s, d, "events").where(F.col("event_type") == kind).selectExpr("user_id", *columns)


C.add("as_of_join", lambda s, d: mt.as_of(_of_type(s, d, "purchase", "event_id", "ts"), _of_type(s, d, "click", "ts AS click_ts"), ["user_id"], "ts", "click_ts", ["click_ts"]).select("event_id", "user_id", "click_ts"),
      """SELECT event_id, p.user_id AS user_id, max(c.ts) AS click_ts FROM events p LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'click') c
      ON p.user_id = c.user_id AND c.ts <= p.ts WHERE event_type = 'purchase' GROUP BY 1, 2""")
C.add("survival_at", lambda s, d: mt.as_of(textual.surv(s, d).select("user_id", "grp", "dur"), ts.kaplan_meier(textual.surv(s, d), "dur", "ev", ["grp"]), ["grp"], "dur", "time", ["survival"]).select("user_id", F.coalesce("survival", F.lit(1.0)).alias("survival")),
      f"SELECT s.user_id, coalesce(k.survival, 1.0) AS survival FROM {textual._SV} s ASOF LEFT JOIN ({textual.C.oracles['kaplan_meier']}) k ON s.grp = k.grp AND s.dur >= k.time", "survival")


def _arms(s, d):
    c = table(s, d, "customer").selectExpr("c_custkey AS id", "c_acctbal AS score", "cast(c_nationkey as double) AS y", "c_mktsegment = 'BUILDING' AS treated")
    return c, c.where("treated"), c.where("not treated")


_MATCH = """(SELECT t.c_custkey AS id, c.c_custkey AS match, abs(t.c_acctbal - c.c_acctbal) AS gap, t.c_nationkey - c.c_nationkey AS d,
  row_number() OVER (PARTITION BY t.c_custkey ORDER BY abs(t.c_acctbal - c.c_acctbal), c.c_custkey) AS r
  FROM customer t JOIN customer c ON t.c_mktsegment = 'BUILDING' AND c.c_mktsegment <> 'BUILDING' AND abs(t.c_acctbal - c.c_acctbal) <= 20)"""
C.add("nearest_within_caliper", lambda s, d: (lambda a: mt.nearest_within(a[1], a[2], "id", "score", 20.0))(_arms(s, d)), f"SELECT id, match, gap FROM {_MATCH} WHERE r = 1", "gap")
C.add("matched_treatment_effect", lambda s, d: (lambda a: mt.treated_effect(mt.nearest_within(a[1], a[2], "id", "score", 20.0), a[0], "id", "y"))(_arms(s, d)),
      f"SELECT avg(d) AS att, count(*) AS n_matched FROM {_MATCH} WHERE r = 1", "att", "n_matched")


def _names(s, d):
    n = table(s, d, "nation")
    both = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"))
    return both.select(F.col("a.n_nationkey").alias("i"), F.col("b.n_nationkey").alias("j"), F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))


_NAMES = "(SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)"
_PREFIX = " + ".join(f"CASE WHEN substr(x, 1, {k}) = substr(y, 1, {k}) THEN 1 ELSE 0 END" for k in (1, 2, 3, 4))
C.add("jaro_similarity", lambda s, d: _names(s, d).select("i", "j", st.jaro(F.col("x"), F.col("y")).alias("sim")), f"SELECT i, j, jaro_similarity(x, y) AS sim FROM {_NAMES}", "sim")
C.add("jaro_winkler_similarity", lambda s, d: _names(s, d).select("i", "j", st.jaro_winkler(F.col("x"), F.col("y")).alias("sim")),
      f"SELECT i, j, jaro_similarity(x, y) + 0.1 * ({_PREFIX}) * (1 - jaro_similarity(x, y)) AS sim FROM {_NAMES}", "sim")
C.add("edit_tables", lambda s, d: _names(s, d).select("i", "j", *[f(F.col("x"), F.col("y")).alias(n) for n, f in (("lcs", st.common_subsequence), ("alignment", st.needleman_wunsch), ("edits", st.damerau_levenshtein))]))
