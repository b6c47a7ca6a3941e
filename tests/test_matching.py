"""Joins by order and string likeness against brute force."""

import random

from pyspark.sql import functions as F

from murmuration.operators import matching, strings


def edit_table(a, b, edge, cell):
    table = {(i, 0): i * edge for i in range(len(a) + 1)} | {(0, j): j * edge for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = cell(table, i, j, a[i - 1] == b[j - 1])
    return table[len(a), len(b)]


def swaps(a, b):
    def cell(t, i, j, same):
        best = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (not same))
        crossed = i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]
        return min(best, t[i - 2, j - 2] + 1) if crossed else best

    return edit_table(a, b, 1, cell)


def test_edit_tables(spark):
    rng = random.Random(3)
    words = ["", "a", "ab", "ba", "ca", "abc", "teh", "the", "kitten", "sitting"] + ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(6)]
    pairs = [(x, y) for x in words for y in words]
    df = spark.createDataFrame(pairs, "x string, y string")
    x, y = F.col("x"), F.col("y")
    got = df.select("x", "y", strings.common_subsequence(x, y).alias("l"), strings.needleman_wunsch(x, y).alias("n"), strings.damerau_levenshtein(x, y).alias("d"), strings.jaro(x, y).alias("j")).collect()
    for r in got:
        assert r.l == edit_table(r.x, r.y, 0, lambda t, i, j, same: t[i - 1, j - 1] + 1 if same else max(t[i - 1, j], t[i, j - 1]))
        assert r.n == edit_table(r.x, r.y, -1, lambda t, i, j, same: max(t[i - 1, j - 1] + (1 if same else -1), t[i - 1, j] - 1, t[i, j - 1] - 1))
        assert r.d == swaps(r.x, r.y)
        assert 0 <= r.j <= 1 and (r.j == 1) == (r.x == r.y)


def test_known_similarities_and_nulls(spark):
    df = spark.createDataFrame([("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), (None, "a")], "x string, y string")
    rows = df.select(strings.jaro(F.col("x"), F.col("y")).alias("j"), strings.jaro_winkler(F.col("x"), F.col("y")).alias("w")).collect()
    assert [round(r.j, 4) for r in rows[:2]] == [0.9444, 0.7667]
    assert [round(r.w, 4) for r in rows[:2]] == [0.9611, 0.8133]
    assert rows[2].j is None


def test_as_of_and_its_edges(spark):
    left = spark.createDataFrame([("a", 1, 0), ("a", 5, 1), ("a", 9, 2), ("b", 5, 3), ("a", None, 4)], "k string, t int, n int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 7, "z"), ("c", 1, "w"), ("a", None, "q")], "k string, u int, v string")
    got = {r.n: r.v for r in matching.as_of(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {0: None, 1: "y", 2: "z", 3: None, 4: None}
    assert matching.as_of(left.where("false"), right, ["k"], "t", "u", ["v"]).count() == 0


def test_nearest_within_a_caliper(spark):
    rng = random.Random(8)
    treated = [(i, rng.randrange(400) / 8) for i in range(60)] + [(998, None)]
    control = [(1000 + i, rng.randrange(400) / 8) for i in range(50)] + [(999, 500.0), (997, None)]
    schema = "id long, score double"
    got = matching.nearest_within(spark.createDataFrame(treated, schema), spark.createDataFrame(control, schema), "id", "score", 0.75).collect()
    want = {}
    for i, s in treated:
        near = [(abs(s - z), c) for c, z in control if s is not None and z is not None and abs(s - z) <= 0.75]
        if near:
            want[i] = min(near)
    assert {r.id: (r.gap, r.match) for r in got} == want
