"""Nearest rows against brute force: copies, ties, few coordinates and many, several blocks, odd numbers."""

import numpy as np
import pytest

from murmuration.operators import learners, nearest, neighbours


def brute(asked, rows, k, meets=lambda q, i: True):
    out = {}
    for q, v in asked:
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))), i) for i, w in rows if i != q and meets(q, i))
        out[q] = [(i, d) for d, i in near[:k]]
    return out


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.q, r["rank"])):
        out.setdefault(r.q, []).append((r.id, r.distance))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<double>")


@pytest.mark.parametrize("dim", [2, 12])
def test_nearest_rows_are_those_of_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 400 * dim)
    monkeypatch.setattr(neighbours, "SEEDS", 30)
    r = np.random.default_rng(dim)
    points = np.round(r.normal(size=(260, dim)) * (10 if dim == 2 else 1), 1)
    rows = [(i, points[i % 260]) for i in range(600)]
    rows += [(1000 + i, points[0]) for i in range(50)]
    asked = [x for x in rows if x[0] % 3 == 0] + [(5000, points[1]), (5001, points[2] * 30)]
    assert as_lists(learners.knn(frame(spark, asked), frame(spark, rows), "id", "v", 4)) == brute(asked, rows, 4)


def test_fewer_rows_than_asked_for(spark):
    rows = [(1, (0, 0)), (2, (0, 1)), (3, (0, -1))]
    assert as_lists(learners.knn(frame(spark, rows), frame(spark, rows), "id", "v", 9)) == brute(rows, rows, 9)
    assert learners.knn(frame(spark, []), frame(spark, rows), "id", "v", 9).count() == 0
    assert learners.knn(frame(spark, rows), frame(spark, []), "id", "v", 9).count() == 0


def test_cells_and_buckets_meet_what_they_met(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6)) for i in range(400)]
    rows += [(i + 400, v) for i, v in rows[:40]]
    asked = rows[::7]
    centres = [list(v) for _, v in rows[3:200:31]]
    order = {i: sorted(range(len(centres)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centres[c])), c)) for i, v in rows}
    got = nearest.cell_search(frame(spark, asked), frame(spark, rows), centres, "id", "v", 5, 2)
    assert as_lists(got) == brute(asked, rows, 5, lambda q, i: order[i][0] in order[q][:2])
    codes = {i: {} for i, _ in rows}
    for x in learners.sign_buckets(frame(spark, rows), "id", "v", 6, 3, 5).collect():
        codes[x.id][x.table] = x.code
    got = nearest.lsh_search(frame(spark, asked), frame(spark, rows), "id", "v", 6, 5, 3, 5)
    assert as_lists(got) == brute(asked, rows, 5, lambda q, i: any(codes[q][t] == codes[i][t] for t in range(3)))
