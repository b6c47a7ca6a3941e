import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.operators import effects as ef
from murmuration.operators import incremental as inc


def trial(spark, n=4000, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    t = (r.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    y = 1 + 2 * x[:, 0] - x[:, 1] + t * (3 + x[:, 1]) + r.normal(0, 0.3, n)
    rows = [(i, float(a), float(b), int(c), float(d)) for i, ((a, b), c, d) in enumerate(zip(x, t, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, t int, y double").repartition(5), x, t, y


def test_learners_find_a_planted_effect(spark):
    df, x, t, y = trial(spark)
    for learner in (ef.t_learner, ef.x_learner):
        got = {r.id: r.e for r in df.select("id", learner(df, "t", "y", ["a", "b"]).alias("e")).collect()}
        assert np.abs(np.array([got[i] for i in range(len(t))]) - (3 + x[:, 1])).max() < 0.25
    found = ef.double_ml(df, "t", "y", ["a", "b"], "id", 4).first()
    # The raw difference of means is far off, since a moves both.
    assert abs(found.effect - 3) < 0.15 and abs(y[t == 1].mean() - y[t == 0].mean() - 3) > 1
    assert 0 < found.se < 0.1 and found.n == len(t)


def test_rows_that_lack_a_value_say_nothing(spark):
    df, *_ = trial(spark, 500)
    odd = spark.createDataFrame([(9001, None, 0.0, 1, 5.0), (9002, 0.0, 0.0, None, 5.0), (9003, 0.0, 0.0, 1, None)], df.schema)
    a, b = (ef.double_ml(x, "t", "y", ["a", "b"], "id", 3).first() for x in (df, df.union(odd)))
    assert a.n == b.n == 500 and math.isclose(a.effect, b.effect, rel_tol=1e-9)
    none = ef.double_ml(df.withColumn("t", F.lit(1)), "t", "y", ["a"], "id", 2).first()
    assert none.effect is None or abs(none.effect) < 1e9


def test_cross_validated_penalty(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 8))
    y = x[:, 0] + r.normal(0, 2, 60)
    names = [f"x{j}" for j in range(8)]
    df = spark.createDataFrame([(i, *map(float, row), float(v)) for i, (row, v) in enumerate(zip(x, y))], "id long, " + ", ".join(f"{n} double" for n in names) + ", y double")
    folds = {f.id: f._fold for f in ef.with_folds(df, "id", 3).select("id", "_fold").collect()}
    assert set(folds.values()) == {0, 1, 2}
    alphas = [0.0, 3.0, 30.0, 1000.0]
    fit, table = ef.ridge_cv(df, names, "y", alphas, "id", 3)
    k = np.array([folds[i] for i in range(60)])
    want = {}
    for alpha in alphas:
        errors = np.zeros(60)
        for f in range(3):
            own, rest = k == f, k != f
            m, c = x[rest].mean(axis=0), y[rest].mean()
            b = np.linalg.solve((x[rest] - m).T @ (x[rest] - m) + alpha * np.eye(8), (x[rest] - m).T @ (y[rest] - c))
            errors[own] = (y[own] - c - (x[own] - m) @ b) ** 2
        want[alpha] = errors.mean()
    got = {e.alpha: e.mse for e in table.collect()}
    assert all(math.isclose(got[a], want[a], rel_tol=1e-9) for a in alphas)
    best = min(want, key=want.get)
    m = x.mean(axis=0)
    b = np.linalg.solve((x - m).T @ (x - m) + best * np.eye(8), (x - m).T @ (y - y.mean()))
    assert np.allclose(fit.coefficients, b)
    with pytest.raises(ValueError):
        ef.ridge_cv(df.limit(0), names, "y", alphas, "id")


def test_robust_fit_is_not_moved_by_outliers(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=500)
    y = 2 + 3 * x + r.normal(0, 0.2, 500)
    y[:25] += 100
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None)], "x double, y double")
    fit = ef.huber(df, ["x"], "y")
    plain = np.polyfit(x, y, 1)
    assert abs(fit.coefficients[0] - 3) < 0.3 and abs(fit.intercept - 2) < 1.0 < abs(plain[1] - 2)
    line = df.where("x is not null").withColumn("y", F.col("x") * 2 + 1)
    exact = ef.huber(line, ["x"], "y")
    assert abs(exact.coefficients[0] - 2) < 1e-9 and abs(exact.intercept - 1) < 1e-9


def test_naive_bayes_grows_with_a_stream(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(i, "a" if i % 3 else "b", float(v), float(w)) for i, (v, w) in enumerate(r.normal(size=(900, 2)) + np.array([[2.0, 0] if i % 3 else [-2.0, 1] for i in range(900)]))]
    schema = "i long, c string, x double, y double"
    for k in range(3):
        spark.createDataFrame(rows[k * 300 : (k + 1) * 300], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    inc.grow_stream(stream, ["x", "y"], "c", str(tmp_path / "check"), held).awaitTermination()
    df = spark.createDataFrame(rows, schema)
    whole = {s.c: s for s in inc.sums(df, ["x", "y"], "c").collect()}
    assert held["batch"] == 2 and all(math.isclose(s[k], whole[s.c][k], rel_tol=1e-9) for s in held["state"].collect() for k in ("n", "s0", "p0_1", "p1_1"))
    hits = df.where(inc.naive_bayes(held["state"], "c", ["x", "y"]) == F.col("c")).count()
    assert hits > 860
