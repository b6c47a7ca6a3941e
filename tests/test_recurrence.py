import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.operators import recurrence as rc


def series(seed=1, lengths=(1, 2, 3, 40, 700, 13, 0, 260)):
    r = random.Random(seed)
    rows = [(f"k{j}" if j else None, i, r.gauss(10 + i / 50, 3) + 4 * math.sin(i)) for j, n in enumerate(lengths) for i in range(n)]
    rows += [("k4", 9000 + i, None) for i in range(5)] + [("gone", 0, float("nan"))]
    r.shuffle(rows)
    return rows


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, "k string, t long, x double").repartition(parts)


def by_key(rows):
    out = {}
    for k, t, x in sorted((r for r in rows if r[2] is not None and not math.isnan(r[2])), key=lambda r: (str(r[0]), r[1])):
        out.setdefault(k, []).append((t, x))
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert np.allclose(got[key], want[key], rtol=1e-9, atol=1e-9), key


def test_holt_equals_the_recursion_in_more_parts_than_series(spark):
    rows = series()
    for alpha, beta, phi in ((0.3, 0.1, 1.0), (0.6, 0.3, 0.8), (1.0, 1.0, 1.0)):
        want = {}
        for k, xs in by_key(rows).items():
            level, trend = xs[0][1], xs[1][1] - xs[0][1] if len(xs) > 1 else 0.0
            for t, x in xs:
                ahead = level + phi * trend
                new = alpha * x + (1 - alpha) * ahead
                level, trend = new, beta * (new - level) + (1 - beta) * phi * trend
                want[k, t] = (ahead, level, trend)
        got = {(r.k, r.t): (r.fitted, r.level, r.trend) for r in rc.holt(table(spark, rows), "x", ["t"], ["k"], alpha, beta, phi).collect()}
        close(got, want)


@pytest.mark.parametrize("season, trend", [(4, True), (7, False), (1, True)])
def test_holt_winters_and_its_forecasts(spark, season, trend):
    rows, m, want, ahead = series(2), season, {}, {}
    for k, xs in by_key(rows).items():
        v = [x for _, x in xs]
        if len(v) < 2 * m:
            continue
        level = sum(v[:m]) / m
        b = (sum(v[m : 2 * m]) / m - level) / m if trend else 0.0
        s = [x - level for x in v[:m]]
        for i, (t, x) in enumerate(xs):
            fitted = level + b + s[i % m]
            new = 0.3 * (x - s[i % m]) + 0.7 * (level + b)
            s[i % m] = 0.1 * (x - new) + 0.9 * s[i % m]
            level, b = new, 0.1 * (new - level) + 0.9 * b if trend else 0.0
            want[k, t] = (fitted, level, b, s[i % m])
        for h in range(1, 10):
            ahead[k, h] = (level + h * b + s[(len(v) + h - 1) % m],)
    found = rc.holt_winters(table(spark, rows), "x", ["t"], ["k"], m, trend=trend)
    close({(r.k, r.t): (r.fitted, r.level, r.trend, r.seasonal) for r in found.collect()}, want)
    close({(r.k, r.step): (r.forecast,) for r in rc.forecast(found, ["t"], ["k"], 9).collect()}, ahead)


def test_arma_residuals_lags_and_least_squares(spark):
    rows = series(3)
    for ar, ma in (([0.5, -0.2], [0.3]), ([], [0.4, 0.1, -0.2]), ([0.9], []), ([], [])):
        want = {}
        for k, xs in by_key(rows).items():
            e = []
            for i, (t, x) in enumerate(xs):
                old = sum(a * xs[i - 1 - j][1] for j, a in enumerate(ar) if i > j) + sum(a * e[i - 1 - j] for j, a in enumerate(ma) if i > j)
                e.append(x - old)
                want[k, t] = (e[-1],)
        got = {(r.k, r.t): (r.resid,) for r in rc.arma_residuals(table(spark, rows), "x", ["t"], ["k"], ar, ma).collect()}
        close(got, want)
    for r in rc.lags(table(spark, rows), "x", ["t"], ["k"], 3).collect():
        xs = [x for _, x in by_key(rows)[r.k]]
        i = [t for t, _ in by_key(rows)[r.k]].index(r.t)
        assert r._at == i and np.allclose(r.lags, [xs[i - j] if i >= j else 0.0 for j in (1, 2, 3)])
    fits = {r.k: r for r in rc.autoregression(table(spark, rows), "x", ["t"], ["k"], 2).collect()}
    for k, xs in by_key(rows).items():
        v = np.array([x for _, x in xs])
        if len(v) < 3:
            assert k not in fits
            continue
        c = v - v.mean()
        a = np.column_stack([c[1:-1], c[:-2]])
        w = np.linalg.lstsq(a, c[2:], rcond=1e-12)[0]
        assert np.allclose(fits[k].coefficients, w, atol=1e-6) and fits[k].n == len(v) - 2
        assert abs(fits[k].sigma2 - (c[2:] - a @ w).var()) < 1e-6


def test_kalman_filters(spark):
    rows = series(4)
    f, h, q, r = np.array([[1.0, 1], [0, 1]]), np.array([[1.0, 0]]), np.diag([0.5, 0.01]), np.array([[4.0]])
    want = {}
    for k, xs in by_key(rows).items():
        x, p = np.array([1.0, -1.0]), np.diag([2.0, 3.0])
        for t, z in xs:
            x, p = f @ x, f @ p @ f.T + q
            gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
            x, p = x + gain @ (z - h @ x), (np.eye(2) - gain @ h) @ p
            want[k, t] = (*x, *p.ravel())
    got = rc.kalman_filter(table(spark, rows), ["x"], ["t"], ["k"], f, h, q, r, [1, -1], np.diag([2.0, 3.0]))
    close({(g.k, g.t): (*g["mean"], *g.covariance) for g in got.collect()}, want)
    with pytest.raises(ValueError):
        rc.kalman_gains(1.0, 1.0, 0.0, 1.0, 1.0, settle=1000)


def test_two_measurements_and_no_groups(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "t long, a double, b double").repartition(4)
    h, noise = np.array([[1.0], [0.5]]), np.diag([1.0, 2.0])
    x, p, want = 0.0, 1.0, {}
    for t, a, b in rows:
        p += 0.3
        gain = (p * h.T) @ np.linalg.inv(p * h @ h.T + noise)
        x += float((gain @ (np.array([a, b]) - h.ravel() * x)).item())
        p *= 1 - float((gain @ h).item())
        want[t,] = (x,)
    got = rc.kalman_filter(df, ["a", "b"], ["t"], [], 1.0, h, 0.3, noise)
    close({(g.t,): (g["mean"][0],) for g in got.collect()}, want)
    level, smooth = rows[0][1], {}
    for t, a, _ in rows:
        smooth[t,] = (level, 0.3 * a + 0.7 * level)
        level = smooth[t,][1]
    close({(g.t,): (g.fitted, g.level) for g in rc.simple_smoothing(df, "a", ["t"], []).collect()}, smooth)


def test_a_row_that_starts_a_part_starts_its_series(spark):
    """One series for each part, and series of one row: every border between parts is one between series."""
    rows = [(f"k{j:03d}", 0, float(j)) for j in range(200)]
    got = {r.k: (r.fitted, r.level) for r in rc.simple_smoothing(table(spark, rows), "x", ["t"], ["k"]).collect()}
    assert all(abs(v - int(k[1:])) < 1e-9 for k, pair in got.items() for v in pair) and len(got) == 200
    assert rc.holt(table(spark, []), "x", ["t"], ["k"]).count() == 0
    assert rc.holt_winters(table(spark, rows), "x", ["t"], ["k"], 4).count() == 0


def test_one_long_series_is_spread_over_tasks(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.col("id") % 17).cast("double").alias("x"))
    found = rc.simple_smoothing(df, "x", ["t"], ["k"], 0.2)
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    level, want = 0.0, []
    for i in range(n):
        level = 0.2 * (i % 17) + 0.8 * level
        want.append(level)
    got = [r.level for r in found.orderBy("t").collect()]
    assert np.allclose(got, want, atol=1e-9)
