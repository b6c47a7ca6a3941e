import math

import numpy as np
import pytest

from murmuration.llm import whitening


def table(spark, vectors):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in vectors]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, x int, component int").repartition(3)


def usable(vectors):
    kept = [(i, v) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max((len(v) for _, v in kept), default=0)
    return [(i, np.array([math.floor(256 * float(np.float32(x))) for x in v] + [0] * (d - len(v)), dtype=object)) for i, v in kept]


def holds(spark, vectors, components=4):
    rows = usable(vectors)
    got = whitening.whitened(table(spark, vectors), components=components).collect()
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=float)
    n = len(fit)
    e, u = np.linalg.eigh(np.atleast_2d(np.cov(fit.T, bias=True)))
    e, u = e[::-1], u[:, ::-1]
    real = int((e[:components] > 1e-9 * e.sum()).sum())
    assert len(got) == len(rows) * real and {r.n for r in got} <= {n}
    sums = [sum(int(x) for x in column) for column in fit.T]
    z = (fit_of(rows) - fit.mean(axis=0)) @ u[:, :real] / np.sqrt(e[:real])
    by = {}
    for r in got:
        by.setdefault((r.component, r.vec_id), []).append(r)
    for k in range(real):
        mine = {i: sorted(x.whitened for x in by[k + 1, i]) for i in {i for i, _ in rows}}
        theirs = {}
        for (i, _), v in zip(rows, z[:, k]):
            theirs.setdefault(i, []).append(v)
        scale = max(abs(z[:, k]).max(), 1)
        errors = [max(abs(a - b) for i in mine for a, b in zip(mine[i], sorted(s * v for v in theirs[i]))) for s in (1, -1)]
        assert min(errors) < 1e-7 * scale
        assert all(abs(r.explained - e[k] / e.sum()) < 1e-10 for r in got if r.component == k + 1)
    exact = {}
    for i, x in rows:
        exact.setdefault(i, set()).add(sum((n * int(a) - s) ** 2 for a, s in zip(x, sums)))
    assert all(r.deviation in exact[r.vec_id] for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert max(r.residual for r in got) <= 1e-9 * e[0]


def fit_of(rows):
    return np.array([x for _, x in rows], dtype=float)


def test_equals_a_full_eigendecomposition(spark):
    r = np.random.default_rng(1)
    basis = r.normal(size=(40, 40))
    data = r.normal(size=(300, 40)) * np.linspace(2, 0.2, 40) @ basis
    holds(spark, [(i, v) for i, v in enumerate(data)] + [(1000 + i, data[7]) for i in range(40)])


def test_awkward_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(60, 6)))]
    rows += [(100, None), (101, [1, None, 1, 1, 1, 1]), (102, [math.nan] * 6), (103, [math.inf] + [0] * 5), (104, [-0.0] * 6), (105, [1.5, 2.5]), (106, []), (None, [1] * 6), (3, [2] * 6), (107, [1e-9, -1e-9, 0, 0, 0, 0])]
    holds(spark, rows)


@pytest.mark.parametrize("dimensions", [1, 2, 3, 13])
def test_few_dimensions(spark, dimensions):
    r = np.random.default_rng(dimensions)
    holds(spark, [(i, v) for i, v in enumerate(r.normal(size=(30, dimensions)))])


def test_tables_without_spread(spark):
    for rows in ([], [(1, None)], [(1, [1, 2]), (2, [1, 2])], [(1, [])]):
        got = whitening.whitened(table(spark, rows))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "residual", "identity_error"]


def test_deviations_beyond_64_bits_are_null(spark):
    got = whitening.whitened(table(spark, [(1, [1e9, 0]), (2, [-1e9, 3]), (3, [5, 5])])).collect()
    exact = [(256 * 10**9, 0), (-256 * 10**9, 768), (1280, 1280)]
    s = [sum(c) for c in zip(*exact)]
    want = [sum((3 * a - b) ** 2 for a, b in zip(x, s)) for x in exact]
    assert {r.vec_id: r.deviation for r in got} == {i: v if v < 1 << 63 else None for i, v in enumerate(want, 1)}


def test_close_and_equal_eigenvalues():
    r = np.random.default_rng(4)
    for values in (np.r_[[1, 1 - 1e-4, 1 - 2e-4, 1 - 3e-4], np.linspace(0.99, 0, 60)], np.r_[np.ones(20), np.zeros(30)], np.linspace(1, 0.9, 80) ** 3):
        q = np.linalg.qr(r.normal(size=(len(values), len(values))))[0]
        a = (q * values) @ q.T
        e, v, norms, passes = whitening.lobpcg(lambda block: a @ block, len(values), 4)
        assert np.abs(e - np.sort(values)[::-1][:4]).max() < 1e-12 and norms.max() < 1e-10 and passes < 200
        assert np.abs(v @ v.T - np.eye(4)).max() < 1e-12 and np.abs(a @ v.T - v.T * e).max() < 1e-10
