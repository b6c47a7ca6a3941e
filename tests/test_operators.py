"""Operators against NumPy or hand-made results where SQL has no twin."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.functions import distributions as dist
from murmuration.operators import columns, graph, learners, linear, patterns, preprocessing, selection, text
from murmuration.operators.ordering import numbered


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = 2 + x @ [1.5, -0.5, 0.25] + rng.normal(scale=0.1, size=400)
    rows = [(i, *map(float, r), float(v), int(v > 2), i % 3) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, z int, g int").cache(), x, y


def test_least_squares_equal_numpy(points):
    df, x, y = points
    design = np.column_stack([np.ones(len(x)), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    got = {r.term: r for r in linear.ols(df, ["a", "b", "c"], "y").collect()}
    assert np.allclose([got[t].coefficient for t in ("intercept", "a", "b", "c")], want)
    assert got["a"].p < 1e-10 and got["a"].r2 > 0.9
    r = linear.ridge(df, ["a", "b", "c"], "y", 10.0)
    centred = x - x.mean(0)
    assert np.allclose(r.coefficients, np.linalg.solve(centred.T @ centred + 10 * np.eye(3), centred.T @ (y - y.mean())))


def test_lasso_meets_its_optimality_conditions(points):
    df, x, y = points
    b = np.array(linear.elastic_net(df, ["a", "b", "c"], "y", 0.3).coefficients)
    g = (x - x.mean(0)).T @ (y - y.mean() - (x - x.mean(0)) @ b) / len(y)
    for gj, bj in zip(g, b):
        assert abs(gj - 0.3 * np.sign(bj)) < 1e-6 if bj else abs(gj) <= 0.3 + 1e-6


def test_logistic_gradient_vanishes(points):
    df, x, _ = points
    z = np.array([r.z for r in df.orderBy("id").collect()])
    m = linear.logistic(df, ["a", "b", "c"], "z", 1.0)
    p = 1 / (1 + np.exp(-(m.intercept + x @ m.coefficients)))
    assert abs((p - z).sum()) < 1e-6 and np.allclose(x.T @ (p - z) + np.array(m.coefficients), 0, atol=1e-6)


def test_pca_equals_numpy(points):
    df, x, _ = points
    _, c, v = linear.pca(df, ["a", "b", "c"], 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(v, values[::-1][:2]) and np.allclose(np.abs(c @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-8)


def test_trees_and_boosting_fit(points):
    df, _, _ = points
    tree = learners.fit_tree(df, ["a", "b", "c"], -F.col("y"), F.lit(1.0), 4, 16, 0.0)
    rss, tss = df.agg(F.sum((F.col("y") - tree.column()) ** 2), F.var_pop("y") * F.count("*")).first()
    assert rss < 0.25 * tss
    score = learners.fit_boosting(df, ["a", "b", "c"], "z", 5, 0.5, "logistic", max_depth=2)
    right = df.agg(F.avg(((score > 0.5).cast("int") == F.col("z")).cast("double"))).first()[0]
    assert right > 0.9


def test_clusters_of_blobs(spark):
    rng = np.random.default_rng(2)
    centres = [(0, 0), (5, 5), (-5, 5)]
    rows = [(i, float(cx + rng.normal(scale=0.3)), float(cy + rng.normal(scale=0.3)), i % 3) for i in range(300) for cx, cy in [centres[i % 3]]]
    df = spark.createDataFrame(rows, "id long, x double, y double, k int")
    found = learners.k_means(df, ["x", "y"], learners.seed_centres(df, ["x", "y"], 3))
    assert found.predict(df).groupBy("k").agg(F.count_distinct("cluster").alias("n")).agg(F.max("n")).first()[0] == 1
    dense = learners.grid_dbscan(df, ["x", "y"], "id", 0.6, 5).join(df, "id").where("cluster is not null")
    assert dense.groupBy("k").agg(F.count_distinct("cluster").alias("n")).agg(F.max("n")).first()[0] == 1


def test_places_in_an_order(spark):
    df = spark.range(5000).selectExpr("id", "xxhash64(id) % 100 AS v", "id % 3 AS g")
    rows = numbered(df, ["v", "id"]).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r._at)] == [r.id for r in sorted(rows, key=lambda r: (r.v, r.id))]
    assert {r._n for r in rows} == {5000} and sorted(r._at for r in rows) == list(range(5000))
    grouped = numbered(df, ["v", "id"], ["g"]).collect()
    for g in range(3):
        assert sorted(r._at for r in grouped if r.g == g) == list(range(sum(r.g == g for r in grouped)))
    assert numbered(df.limit(0), ["v", "id"]).count() == 0


def test_splits_cover_all_rows(spark):
    df = spark.range(103).selectExpr("id", "id % 4 AS y")
    sizes = [r["count"] for r in selection.k_fold(df, ["id"], 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [21, 21, 21, 20, 20]
    assert selection.train_test_split(df, ["id"], 0.25).where("is_test").count() == math.ceil(103 * 0.25)
    assert {r["count"] for r in selection.over_sample(df, "y", ["id"]).groupBy("y").count().collect()} == {26}


def test_distributions_equal_known_values():
    assert math.isclose(dist.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(dist.f_tail(4.351243503129, 1, 20), 0.05, rel_tol=1e-6)
    assert math.isclose(dist.t_two_sided(2.085963447265837, 20), 0.05, rel_tol=1e-9)
    assert math.isclose(dist.normal_ppf(0.975), 1.959963984540054, rel_tol=1e-12)


def test_encoders_of_unseen_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    with pytest.raises(Exception, match="unseen label"):
        preprocessing.label_encode(spark.createDataFrame([("x",)], "c string"), "c", preprocessing.categories(df, "c")).collect()
    rows = preprocessing.one_hot(df, "c", ["a"], handle_unknown="ignore").collect()
    assert [r["c=a"] for r in rows] == [1.0, 0.0, 0.0]


def test_column_functions(spark):
    row = spark.range(1).select(
        columns.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"),
        columns.log_softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("l"),
        columns.sigmoid(F.lit(-800.0)).alias("g"),
        columns.crps_ensemble(F.array(F.lit(1.0), F.lit(3.0)), F.lit(2.0)).alias("c"),
        columns.energy_score(F.array(F.lit(0.0), F.lit(0.0))).alias("e"),
        columns.soft_threshold(F.lit(-3.0), 1.0).alias("t"),
        text.soundex(F.lit("Tymczak")).alias("x"),
        text.soundex(F.lit("")).alias("o"),
        text.hamming(F.lit("karolin"), F.lit("kathrin")).alias("h"),
    ).first()
    assert row.s == [0.5, 0.5] and math.isclose(row.l[0], -math.log(2)) and row.g == 0.0
    assert row.c == 0.5 and math.isclose(row.e, -math.log(2)) and row.t == -2.0
    assert (row.x, row.o, row.h) == ("T522", "0000", 3)


def test_pagerank_and_rules(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src int, dst int")
    rank = {r.node: r.rank for r in graph.pagerank(edges, max_iter=30).collect()}
    assert math.isclose(sum(rank.values()), 1.0) and rank[1] > rank[4]
    baskets = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["a"],), (["b", "c"],)], "items array<string>")
    sets = {tuple(r["items"]): r.n for r in patterns.frequent_itemsets(baskets, "items", 0.5).collect()}
    assert sets == {("a",): 3, ("b",): 3, ("c",): 2, ("a", "b"): 2, ("b", "c"): 2}
    rules = patterns.association_rules(patterns.frequent_itemsets(baskets, "items", 0.5), 0.9).collect()
    assert [(r.antecedent, r.consequent) for r in rules] == [(["c"], ["b"])]


def test_factors_multiply_and_sum(spark):
    a = spark.createDataFrame([("x", 0.25), ("y", 0.75)], "u string, p double")
    b = spark.createDataFrame([("x", 0, 0.5), ("x", 1, 0.5), ("y", 0, 0.1), ("y", 1, 0.9)], "u string, v int, p double")
    got = {r.u: r.p for r in patterns.eliminate([a, b], ["u"], {"v": 1}).collect()}
    assert math.isclose(got["x"], 0.125 / 0.8) and math.isclose(got["y"], 0.675 / 0.8)


def test_bloom_filter_has_no_false_negatives(spark):
    items = spark.range(300).selectExpr("id * 7 AS k")
    places = learners.bloom_filter(items, "k", 4096, 3)
    assert learners.bloom_contains(items, "k", places, 4096, 3).where("not maybe").count() == 0
    other = spark.range(2000).selectExpr("id * 7 + 3 AS k")
    assert learners.bloom_contains(other, "k", places, 4096, 3).where("maybe").count() < 200


def test_random_planes_keep_near_vectors_together(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(50)]
    rows += [(100 + i, (np.array(v) * 1.0001).tolist()) for i, v in rows]
    codes = learners.sign_buckets(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 8)
    same = codes.alias("a").join(codes.alias("b"), (F.col("a.id") + 100 == F.col("b.id")) & (F.col("a.table") == F.col("b.table")))
    assert same.agg(F.avg((F.col("a.code") == F.col("b.code")).cast("double"))).first()[0] > 0.99


def test_import_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
