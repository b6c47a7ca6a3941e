"""Graph, pattern, probability-table and recommender queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import patterns as pt
from ..session import table
from .inputs import Catalog

C = Catalog()

# Parts are linked if they stand in neighbouring lines of an order.
_E = "(SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"
_U = f"(SELECT src, dst FROM {_E} UNION SELECT dst, src FROM {_E})"
_D = f"(SELECT src AS node, count(*) AS degree FROM {_U} GROUP BY 1)"


def directed(s, d):
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return lines.withColumnRenamed("l_partkey", "src").join(after, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()


def und(s, d):
    return gr.undirected(directed(s, d))


C.add("degrees", lambda s, d: gr.degrees(und(s, d)), f"SELECT * FROM {_D}")
_SCORES = ("adamic_adar", "resource_allocation", "jaccard", "preferential_attachment")
C.add("link_scores", lambda s, d: gr.link_scores(und(s, d)).groupBy("a").agg(F.count("*").alias("pairs"), F.sum("common").alias("common"), *[F.sum(c).alias(c) for c in _SCORES]),
      f"""WITH u AS MATERIALIZED (SELECT * FROM {_U}), d AS MATERIALIZED (SELECT src AS node, count(*) AS degree FROM u GROUP BY 1), p AS (
      SELECT a, b, count(*) AS common, sum(CASE WHEN k > 1 THEN 1 / ln(k) ELSE 0 END) AS adamic_adar, sum(1 / k) AS resource_allocation FROM (SELECT x.dst AS a, y.dst AS b, z.degree AS k FROM u x JOIN u y ON x.src = y.src AND x.dst < y.dst JOIN d z ON z.node = x.src) GROUP BY 1, 2)
      SELECT a, count(*) AS pairs, sum(common) AS common, sum(adamic_adar) AS adamic_adar, sum(resource_allocation) AS resource_allocation, sum(common / (e.degree + f.degree - common)) AS jaccard, sum(e.degree * f.degree) AS preferential_attachment
      FROM p JOIN d e ON e.node = a JOIN d f ON f.node = b GROUP BY a""",
      "adamic_adar resource_allocation jaccard", "pairs common preferential_attachment")
C.add("normalized_adjacency", lambda s, d: gr.normalized_adjacency(und(s, d)),
      f"""WITH l AS (SELECT src, dst FROM {_U} UNION ALL SELECT DISTINCT src, src FROM {_U}), g AS (SELECT src AS node, count(*) AS k FROM l GROUP BY 1)
      SELECT l.src, l.dst, 1 / sqrt(a.k * b.k) AS w FROM l JOIN g a ON a.node = l.src JOIN g b ON b.node = l.dst""", "w")


def _pagerank_sql(rounds):
    steps = [f"e AS MATERIALIZED (SELECT * FROM {_E})", "n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)", "o AS MATERIALIZED (SELECT src AS node, count(*) AS k FROM e GROUP BY 1)", "nn AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM n)", "r0 AS (SELECT node, 1 / n AS rank FROM n, nn)"]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT n.node, 0.85 * (coalesce(x, 0) + lost / n) + 0.15 / n AS rank FROM n LEFT JOIN (SELECT e.dst, sum(rank / k) AS x FROM e JOIN r{i} r ON r.node = e.src JOIN o ON o.node = e.src GROUP BY 1) g ON g.dst = n.node,
          (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} r ANTI JOIN o ON o.node = r.node), nn)""")
    return f"WITH {', '.join(steps)} SELECT node, rank / sum(rank) OVER () AS rank FROM r{rounds}"


C.add("pagerank", lambda s, d: gr.pagerank(directed(s, d), max_iter=15, tol=0.0), _pagerank_sql(15), "rank", digits=9)


def _hits_sql(rounds):
    steps = [f"e AS MATERIALIZED (SELECT * FROM {_E})", "n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)", "h0 AS (SELECT node, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS au FROM n)"]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED (SELECT node, au / sqrt(sum(au * au) OVER ()) AS au FROM (SELECT n.node, coalesce(sum(hub), 0) AS au FROM n LEFT JOIN e ON e.dst = n.node LEFT JOIN h{i} h ON h.node = e.src GROUP BY 1))")
        steps.append(f"h{i + 1} AS MATERIALIZED (SELECT node, hub / sqrt(sum(hub * hub) OVER ()) AS hub, au FROM (SELECT n.node, coalesce(sum(a.au), 0) AS hub, any_value(o.au) AS au FROM n JOIN a{i} o ON o.node = n.node LEFT JOIN e ON e.src = n.node LEFT JOIN a{i} a ON a.node = e.dst GROUP BY 1))")
    return f"WITH {', '.join(steps)} SELECT node, hub, au AS authority FROM h{rounds}"


def _labels_sql(rounds):
    steps = [f"u AS MATERIALIZED (SELECT * FROM {_U})", "l0 AS (SELECT DISTINCT src AS node, src AS label FROM u)"]
    for i in range(rounds):
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT src AS node, arg_min(label, (-n, label)) AS label FROM (SELECT src, label, count(*) AS n FROM u JOIN l{i} ON node = dst GROUP BY 1, 2) GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT * FROM l{rounds}"


C.add("hits", lambda s, d: gr.hits(directed(s, d), 5), _hits_sql(5), "hub authority")
C.add("label_propagation", lambda s, d: gr.label_propagation(und(s, d), 4), _labels_sql(4))
C.add("modularity", lambda s, d: gr.modularity(und(s, d), _regions(s, d)),
      f"""WITH m AS (SELECT a.p_brand AS x, b.p_brand AS y FROM {_U} JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey), t AS (SELECT count(*)::DOUBLE AS m2 FROM m)
      SELECT sum(i / m2 - power(k / m2, 2)) AS modularity FROM (SELECT x, count(*) AS k, sum(CASE WHEN x = y THEN 1 ELSE 0 END) AS i FROM m GROUP BY 1), t""", "modularity")
C.add("degree_assortativity", lambda s, d: gr.assortativity(und(s, d)),
      f"SELECT coalesce(corr(a.degree, b.degree), 0) AS assortativity FROM {_U} JOIN {_D} a ON src = a.node JOIN {_D} b ON dst = b.node", "assortativity")
C.add("triangles", lambda s, d: gr.triangles(und(s, d)),
      f"""WITH t AS (SELECT x.src AS node, count(*) / 2 AS t FROM {_U} x JOIN {_U} y ON x.src = y.src AND x.dst <> y.dst JOIN {_U} z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1)
      SELECT g.node, coalesce(t, 0) AS triangles, CASE WHEN degree > 1 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering FROM {_D} g LEFT JOIN t USING (node)""", "clustering", "triangles")
C.add("shortest_paths", lambda s, d: gr.shortest_paths(und(s, d), table(s, d, "part").where("p_partkey IN (1, 8)").select(F.col("p_partkey").alias("node"))).withColumn("depth", F.col("depth").cast("long")),
      f"""WITH RECURSIVE p(source, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey IN (1, 8) UNION SELECT source, dst, depth + 1 FROM p JOIN {_U} ON src = node WHERE depth < 8)
      SELECT source, node, min(depth) AS depth FROM p GROUP BY 1, 2""", "", "depth")
C.add("weisfeiler_lehman", lambda s, d: gr.weisfeiler_lehman(und(s, d), _regions(s, d), 1).withColumn("round", F.col("round").cast("long")),
      f"""WITH l AS (SELECT p_partkey AS node, p_brand AS label FROM part), a AS (SELECT src AS node, string_agg(label, ',' ORDER BY label) AS around FROM {_U} JOIN l ON l.node = dst GROUP BY 1)
      SELECT node, 0 AS round, label FROM l UNION ALL SELECT node, 1, md5(label || CASE WHEN around IS NULL THEN '' ELSE '|' || around END) FROM l LEFT JOIN a USING (node)""", "", "round")


def _regions(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("label"))


# Baskets: the part brands of an order.
_BASKET = "(SELECT DISTINCT l_orderkey AS b, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def baskets(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "part"), F.expr("l_partkey = p_partkey"))
    return j.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("items"))


_SETS = f"""(WITH b AS MATERIALIZED (SELECT * FROM {_BASKET}), t AS (SELECT count(DISTINCT b) AS n FROM b)
  SELECT items, c AS n, c / t.n::DOUBLE AS support FROM (SELECT [item] AS items, count(*) AS c FROM b GROUP BY 1
  UNION ALL SELECT [x.item, y.item], count(*) FROM b x JOIN b y ON x.b = y.b AND x.item < y.item GROUP BY 1
  UNION ALL SELECT [x.item, y.item, z.item], count(*) FROM b x JOIN b y ON x.b = y.b AND x.item < y.item JOIN b z ON z.b = x.b AND y.item < z.item GROUP BY 1), t WHERE c >= 0.012 * t.n)"""
C.add("apriori", lambda s, d: pt.frequent_itemsets(baskets(s, d), "items", 0.012, 3).select(F.array_join("items", ",").alias("items"), "n", "support"),
      f"SELECT array_to_string(items, ',') AS items, n, support FROM {_SETS}", "support", "n")
C.add("association_rules", lambda s, d: pt.association_rules(pt.frequent_itemsets(baskets(s, d), "items", 0.012, 2), 0.0, 0.0).select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), "support", "confidence", "lift"),
      f"""WITH s AS MATERIALIZED (SELECT * FROM {_SETS} WHERE len(items) <= 2), p AS (SELECT items[1] AS x, items[2] AS y, support FROM s WHERE len(items) = 2 UNION ALL SELECT items[2], items[1], support FROM s WHERE len(items) = 2)
      SELECT x AS antecedent, y AS consequent, p.support, p.support / a.support AS confidence, p.support / a.support / c.support AS lift FROM p JOIN s a ON a.items = [x] JOIN s c ON c.items = [y]""", "support confidence lift")
C.add("markov_chain", lambda s, d: pt.transitions(table(s, d, "events"), "event_type", ["ts", "event_id"], ["user_id"]),
      """WITH m AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), s AS (SELECT DISTINCT event_type AS s FROM events),
      g AS (SELECT x.s AS a, y.s AS b FROM s x, s y), c AS (SELECT a, b, count(*) AS n FROM m WHERE b IS NOT NULL GROUP BY 1, 2)
      SELECT a, b, coalesce(n, 0) AS n, (coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY a) AS p FROM g LEFT JOIN c USING (a, b)""", "p", "n")
C.add("conditional_probability_table", lambda s, d: pt.conditional_table(table(s, d, "orders"), "o_orderstatus", ["o_orderpriority"]),
      """WITH v AS (SELECT DISTINCT o_orderstatus FROM orders), q AS (SELECT DISTINCT o_orderpriority FROM orders), c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
      SELECT o_orderpriority, o_orderstatus, (coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY o_orderpriority) AS p FROM q CROSS JOIN v LEFT JOIN c USING (o_orderpriority, o_orderstatus)""", "p")


def _network(s, d):
    li = table(s, d, "lineitem").selectExpr("l_returnflag AS a", "l_linestatus AS b", "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS c")
    return [pt.conditional_table(li, "a", []), pt.conditional_table(li, "b", ["a"]), pt.conditional_table(li, "c", ["b"])]


C.add("variable_elimination", lambda s, d: pt.eliminate(_network(s, d), ["a"], {"c": 1}),
      """WITH l AS (SELECT l_returnflag AS a, l_linestatus AS b, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS c FROM lineitem), av AS (SELECT DISTINCT a FROM l), bv AS (SELECT DISTINCT b FROM l), cv AS (SELECT DISTINCT c FROM l),
      pa AS (SELECT a, (count(*) + 1.0) / ((SELECT count(*) FROM l) + (SELECT count(*) FROM av)) AS p FROM l GROUP BY a),
      pb AS (SELECT a, b, (coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY a) AS p FROM av CROSS JOIN bv LEFT JOIN (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2) USING (a, b)),
      pc AS (SELECT b, c, (coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY b) AS p FROM bv CROSS JOIN cv LEFT JOIN (SELECT b, c, count(*) AS n FROM l GROUP BY 1, 2) USING (b, c)),
      j AS (SELECT a, sum(pa.p * pb.p * pc.p) AS p FROM pa JOIN pb USING (a) JOIN pc USING (b) WHERE c = 1 GROUP BY a) SELECT a, p / sum(p) OVER () AS p FROM j""", "p")
_MI = [f"""SELECT '{x}' AS a, '{y}' AS b, sum(n / nn * ln(n * nn / (nu * nv))) AS mi FROM (SELECT n, sum(n) OVER (PARTITION BY u)::DOUBLE AS nu, sum(n) OVER (PARTITION BY v)::DOUBLE AS nv, sum(n) OVER ()::DOUBLE AS nn
      FROM (SELECT {x} AS u, {y} AS v, count(*) AS n FROM lineitem GROUP BY 1, 2))""" for x, y in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber"))]
C.add("mutual_information", lambda s, d: pt.mutual_information(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]),
      " UNION ALL ".join(_MI), "mi")
C.add("chow_liu_tree", lambda s, d: s.createDataFrame(pt.chow_liu(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]), "a string, b string, mi double"),
      "SELECT a, b, mi FROM (" + " UNION ALL ".join(_MI) + ") ORDER BY mi DESC LIMIT 2", "mi")
_R = "(SELECT o_custkey AS u, l_partkey % 50 AS i, avg(l_quantity) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def ratings(s, d):
    return table(s, d, "orders").join(table(s, d, "lineitem"), F.expr("o_orderkey = l_orderkey")).groupBy(F.col("o_custkey").alias("u"), (F.col("l_partkey") % 50).alias("i")).agg(F.avg("l_quantity").alias("r"))


_DEV = f"(SELECT a.i AS i, b.i AS j, avg(a.r - b.r) AS dev, count(*) AS n FROM {_R} a JOIN {_R} b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2)"
C.add("slope_one", lambda s, d: pt.slope_one(ratings(s, d), "u", "i", "r"), f"SELECT * FROM {_DEV}", "dev", digits=8)
C.add("slope_one_predict", lambda s, d: (lambda r: pt.slope_one_predict(pt.slope_one(r, "u", "i", "r"), r, "u", "i", "r").groupBy("i").agg(F.avg("predicted").alias("mean"), F.count("*").alias("n")))(ratings(s, d)),
      f"""WITH r AS MATERIALIZED (SELECT * FROM {_R}), v AS MATERIALIZED (SELECT * FROM {_DEV}), p AS (SELECT r.u, v.i, sum((r.r + v.dev) * v.n) / sum(v.n) AS predicted FROM r JOIN v ON r.i = v.j GROUP BY 1, 2)
      SELECT i, avg(predicted) AS mean, count(*) AS n FROM p ANTI JOIN r USING (u, i) GROUP BY i""", "mean", digits=3)
C.add("pareto_front", lambda s, d: pt.pareto_front(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "p_partkey").select("p_partkey"),
      "SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))")
C.add("crowding_distance", lambda s, d: pt.crowding_distance(table(s, d, "part"), ["p_retailprice"], ["p_brand"], "p_partkey").select("p_partkey", F.expr("CASE WHEN crowding < 1e300 THEN crowding END").alias("crowding")),
      """WITH c AS (SELECT p_partkey, (lead(p_retailprice) OVER w - lag(p_retailprice) OVER w) AS g, max(p_retailprice) OVER (PARTITION BY p_brand) - min(p_retailprice) OVER (PARTITION BY p_brand) AS s
      FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)) SELECT p_partkey, g / CASE WHEN s = 0 THEN 1 ELSE s END AS crowding FROM c""", "crowding")
