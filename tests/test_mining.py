import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.functions.distributions import digamma_array, log_gamma_array
from murmuration.operators import community as cm
from murmuration.operators import decomposition as dc
from murmuration.operators import isolation as iso
from murmuration.operators import isotonic as it
from murmuration.operators import sequences as sq
from murmuration.operators import topics as tp
from murmuration.streaming import hoeffding as hf


def contains(sequence, pattern):
    rest = iter(sequence)
    return all(x in rest for x in pattern)


@pytest.mark.parametrize("support, longest", [(0.3, None), (4, 3), (0.999, None)])
def test_prefixspan_finds_what_enumeration_finds(spark, support, longest):
    r = random.Random(7)
    sequences = {i: [r.choice("abcd") for _ in range(r.randint(1, 9))] for i in range(14)}
    rows = [(i, t, x) for i, s in sequences.items() for t, x in enumerate(s)] + [(99, 0, None), (None, 1, "a")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "s long, t long, x string")
    least = math.ceil(support * 14 - 1e-9) if isinstance(support, float) else support
    want = {}
    for n in range(1, (longest or 9) + 1):
        level = {p: c for p in itertools.product("abcd", repeat=n) if (c := sum(contains(s, p) for s in sequences.values())) >= least}
        want |= level
        if not level:
            break
    got = {tuple(g["items"]): (g.n, g.support) for g in sq.prefixspan(df, "s", "x", ["t"], support, longest).collect()}
    assert {k: n for k, (n, _) in got.items()} == want and all(abs(s - n / 14) < 1e-12 for n, s in got.values())
    assert sq.prefixspan(df.limit(0), "s", "x", ["t"]).count() == 0


def pooled(points):
    """By the definition: the greatest of the least means around each place."""
    xs = sorted({x for x, _, _ in points})
    t = {x: (sum(y * w for a, y, w in points if a == x), sum(w for a, _, w in points if a == x)) for x in xs}
    mean = lambda a, b: sum(t[x][0] for x in xs[a : b + 1]) / sum(t[x][1] for x in xs[a : b + 1])
    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("part", [1_000, 7, 2])
def test_isotonic_fits_do_not_show_their_parts(spark, part):
    r = random.Random(3)
    for shape in (lambda x: x / 9 + r.gauss(0, 2), lambda x: -float(x), lambda x: float(x), lambda x: 1.0, lambda x: 50.0 - abs(x - 20)):
        points = [(float(x := r.randint(0, 40)), shape(x), r.choice([1.0, 2.0, 0.5])) for _ in range(90)]
        df = spark.createDataFrame([*points, (None, 1.0, 1.0), (1.0, None, 1.0), (1.0, 5.0, 0.0)], "x double, y double, w double")
        want = pooled(points)
        blocks = it.isotonic_blocks(df, "x", "y", "w", part=part)
        steps = sorted((b.low, b.high, b.value) for b in blocks.collect())
        assert all(a[1] < b[0] and a[2] <= b[2] for a, b in zip(steps, steps[1:]))
        ask = spark.createDataFrame([(x,) for x in [*want, -5.0, 99.0, 3.5, None]], "x double")
        for held in (1_000_000, 3):
            got = {g.x: g.fitted for g in it.isotonic_predict(ask, "x", blocks, held=held).collect()}
            assert got.pop(None) is None and len(got) == len(want) + 3
            xs = sorted(want)
            assert all(abs(v - np.interp(x, xs, [want[k] for k in xs])) < 1e-9 for x, v in got.items())
    falling = it.isotonic_blocks(df, "x", "y", "w", increasing=False).orderBy("low").collect()
    assert all(a.value >= b.value for a, b in zip(falling, falling[1:]))
    assert it.isotonic_blocks(df.limit(0), "x", "y").count() == 0
    assert it.isotonic_predict(ask, "x", it.isotonic_blocks(df.limit(0), "x", "y")).where("fitted is not null").count() == 0


def both_ways(spark, pairs):
    return spark.createDataFrame(sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}), "src long, dst long")


def modularity(edges, label):
    m2 = len(edges)
    k = Counter(a for a, _ in edges)
    size = Counter()
    for a, n in k.items():
        size[label[a]] += n
    return sum(label[a] == label[b] for a, b in edges) / m2 - sum((n / m2) ** 2 for n in size.values())


def test_louvain_finds_planted_communities_and_never_falls(spark):
    r = random.Random(2)
    group = lambda i: i // 12
    pairs = [(a, b) for a in range(60) for b in range(a) if r.random() < (0.7 if group(a) == group(b) else 0.03)]
    e = both_ways(spark, pairs)
    labels, reached = cm.louvain(e)
    told = {x.node: x.label for x in labels.collect()}
    rows = [(x.src, x.dst) for x in e.collect()]
    assert all(a < b for a, b in zip(reached, reached[1:])) and abs(reached[-1] - modularity(rows, told)) < 1e-9
    assert reached[-1] >= modularity(rows, {i: group(i) for i in range(60)}) - 1e-9
    assert len({(told[i], group(i)) for i in told}) == 5
    pair, q = cm.louvain(both_ways(spark, [(1, 2)]))
    assert {x.label for x in pair.collect()} == {1} and abs(q[-1]) < 1e-12
    assert cm.louvain(both_ways(spark, [(1, 2)]).limit(0))[0].count() == 0


def test_walks_go_along_edges_by_weight(spark):
    e = spark.createDataFrame([(0, i, float(i)) for i in range(1, 5)] + [(i, 0, 1.0) for i in range(1, 5)] + [(9, 8, 1.0)], "src long, dst long, w double")
    rows = cm.random_walks(e, 6, per_node=400, salts=7).collect()
    at = {(x.start, x.walk, x.step): x.node for x in rows}
    assert len(at) == len(rows)
    edges = {(x.src, x.dst) for x in e.collect()}
    assert all((at[s, w, k - 1], n) in edges for (s, w, k), n in at.items() if k)
    # Every walk but those from 9 and 8 has all its steps.
    assert sum(k == 6 for _, _, k in at) == 5 * 400 and max(k for s, _, k in at if s == 9) == 1
    second = Counter(n for (s, _, k), n in at.items() if k and at[s, _, k - 1] == 0)
    total = sum(second.values())
    assert all(abs(second[i] / total - i / 10) < 0.03 for i in range(1, 5))


def test_walks_over_lists_and_over_slices_agree(spark, monkeypatch):
    e = both_ways(spark, [(1, j) for j in range(2, 30)] + [(2, 3), (4, 5)])
    listed = sorted(cm.random_walks(e, 2, per_node=3).collect())
    from murmuration.operators import ordering

    monkeypatch.setattr(cm, "LIST", 3)
    assert sorted(cm.random_walks(e, 2, per_node=3, salts=7).collect()) == listed
    monkeypatch.undo()
    # Lists need no ranges and no slices.
    monkeypatch.setattr(ordering, "running", None)
    assert sorted(cm.random_walks(e, 2, per_node=3).collect()) == listed


def test_visits_approach_degrees(spark):
    r = random.Random(5)
    e = both_ways(spark, [(a, b) for a in range(20) for b in range(a) if r.random() < 0.3])
    degree = Counter(x.src for x in e.collect())
    seen = Counter(x.node for x in cm.random_walks(e, 8, per_node=100).where("step >= 6").collect())
    n, m = sum(seen.values()), sum(degree.values())
    assert all(abs(seen[i] / n - degree[i] / m) < 0.015 for i in degree)
    vectors = cm.walk_vectors(cm.random_walks(e, 6, per_node=5), 2, 4).collect()
    assert {v.node for v in vectors} <= set(degree) and all(len(v.vector) == 4 for v in vectors)


def sparse(seed, n=60, m=35, share=0.3, positive=True):
    r = np.random.default_rng(seed)
    a = np.where(r.random((n, m)) < share, r.normal(size=(n, m)) * np.linspace(3, 0.3, m), 0.0)
    return np.abs(a) if positive else a


def entries(spark, a):
    rows = [(i, j, float(a[i, j]) / 2) for i, j in zip(*np.nonzero(a)) for _ in range(2)]
    return spark.createDataFrame([(int(i), f"c{j}", v) for i, j, v in rows], "row long, col string, value double")


@pytest.mark.parametrize("positive", [True, False])
def test_singular_triples_equal_numpy(spark, positive):
    a = sparse(1, positive=positive)
    left, values, right = dc.truncated_svd(entries(spark, a), 5, rounds=12)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values, s[:5], rtol=1e-6)
    rows = {x.row: x.vector for x in left.collect()}
    columns = {x.col: x.vector for x in right.collect()}
    for j in range(5):
        mine = np.array([rows.get(i, [0] * 5)[j] for i in range(60)])
        assert min(abs(mine - u[:, j]).max(), abs(mine + u[:, j]).max()) < 1e-3
        other = np.array([columns.get(f"c{i}", [0] * 5)[j] for i in range(35)])
        assert abs(a @ other - values[j] * mine).max() < 1e-3 * values[j]
        assert other[np.abs(other).argmax()] > 0


def test_rows_meet_a_thin_matrix_where_they_stand(spark, monkeypatch):
    a = sparse(2, positive=False)
    df = entries(spark, a)

    def found():
        left, values, right = dc.truncated_svd(df, 2, oversample=2, rounds=1)
        return values, np.array([x.vector for x in left.orderBy("row").collect()]), np.array([x.vector for x in right.orderBy("col").collect()])

    monkeypatch.setattr(dc, "THIN_BYTES", 0, raising=False)
    joined = found()
    monkeypatch.undo()
    # No entry is joined with a vector.
    monkeypatch.setattr(dc, "multiply", None)
    for x, y in zip(found(), joined, strict=True):
        assert np.allclose(x, y, atol=1e-4)


def test_directions_travel_in_groups_where_not_all_fit(spark, monkeypatch):
    r = np.random.default_rng(6)
    a = r.normal(size=(50, 4)) @ r.normal(size=(4, 30)) + 0.01 * r.normal(size=(50, 30))
    df = entries(spark, a)

    def found():
        left, values, right = dc.truncated_svd(df, 3, oversample=4, rounds=2)
        return values, np.array([x.vector for x in left.orderBy("row").collect()]), np.array([x.vector for x in right.orderBy("col").collect()])

    whole = found()
    # One direction of 30 columns has 240 bytes; no entry is joined with a vector.
    monkeypatch.setattr(dc, "multiply", None)
    for size in (240, 500):
        monkeypatch.setattr(dc, "THIN_BYTES", size)
        for x, y in zip(found(), whole, strict=True):
            assert np.allclose(x, y, atol=1e-9)


def test_low_rank_and_empty_matrices(spark):
    a = np.outer([1.0, 2, 0, 3], [1.0, 0, 2])
    left, values, right = dc.truncated_svd(entries(spark, a), 3)
    assert len(values) == 1 and abs(values[0] - np.linalg.norm(a)) < 1e-9 and left.count() == 3 and right.count() == 2
    left, values, right = dc.truncated_svd(entries(spark, a).limit(0), 3)
    assert not len(values) and left.count() == right.count() == 0


def test_nonnegative_factors(spark):
    r = np.random.default_rng(8)
    a = r.random((30, 3)) @ r.random((3, 20)) * (r.random((30, 1)) > 0.1)
    w, h, errors = dc.nmf(entries(spark, a), 3, 40)
    assert all(b <= a_ + 1e-7 for a_, b in zip(errors, errors[1:])) and errors[-1] < 0.15 * np.linalg.norm(a)
    wm = np.zeros((30, 3))
    for x in w.collect():
        wm[x.row] = x.vector
    hm = np.array([v for _, v in sorted((int(x.col[1:]), x.vector) for x in h.collect())]).T
    assert wm.min() >= 0 and hm.min() >= 0 and abs(np.linalg.norm(a - wm @ hm) - errors[-1]) < 1e-6
    with pytest.raises(ValueError):
        dc.nmf(entries(spark, -a), 2)


def test_special_functions():
    x = np.array([0.01, 0.5, 1, 2.5, 7, 30, 1e4])
    assert np.allclose(log_gamma_array(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    h = 1e-5
    numeric = [(math.lgamma(v + h * v) - math.lgamma(v - h * v)) / (2 * h * v) for v in x]
    assert np.allclose(digamma_array(x), numeric, rtol=1e-6) and abs(digamma_array(np.array([1.0]))[0] + np.euler_gamma) < 1e-12


def test_topics_are_found_and_the_bound_rises(spark):
    r = random.Random(4)
    vocabulary = [[f"{c}{i}" for i in range(12)] for c in "abc"]
    rows = []
    for d in range(90):
        words = Counter(r.choice(vocabulary[d % 3] if r.random() < 0.95 else vocabulary[r.randrange(3)]) for _ in range(40))
        rows += [(d, t, n) for t, n in words.items()]
    rows += [(500, None, 3), (501, "a1", 0)]
    counts = spark.createDataFrame(rows, "doc long, term string, tf long")
    topics, mixtures, bounds = tp.latent_dirichlet(counts, "doc", 3, rounds=15)
    assert all(b > a - 1e-3 * abs(a) for a, b in zip(bounds, bounds[1:])) and bounds[-1] > bounds[0]
    best = {}
    for x in tp.top_terms(topics, 8).collect():
        best.setdefault(x.topic, []).append(x.term[0])
    assert sorted(Counter(v).most_common(1)[0][0] for v in best.values()) == ["a", "b", "c"]
    assert all(Counter(v).most_common(1)[0][1] >= 7 for v in best.values())
    mix = {x.doc: x.mixture for x in mixtures.collect()}
    assert set(mix) == set(range(90)) and all(abs(sum(m) - 1) < 1e-9 for m in mix.values())
    of = {d: int(np.argmax(m)) for d, m in mix.items()}
    assert sum(of[d] == of[d % 3] for d in of) >= 87
    assert np.allclose([sum(x.weights[j] for x in topics.collect()) for j in range(3)], 1)


def test_planted_outliers_are_isolated_early(spark):
    r = np.random.default_rng(6)
    data = np.vstack([r.normal(0, 1, (3000, 3)), r.normal(0, 1, (20, 3)) + [8, -8, 8]])
    rows = [(i, *map(float, v)) for i, v in enumerate(data)] + [(9000, None, 0.0, 0.0), (9001, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(4)
    forest = iso.fit_isolation_forest(df, "id", ["a", "b", "c"], 60)
    assert len(forest.trees) == 60 and forest.sample == 256
    got = {x.id: x.score for x in iso.isolation_scores(df, forest).collect()}
    assert got.pop(9000) is None and got.pop(9001) is None
    first = sorted(got, key=lambda i: -got[i])[:20]
    assert sum(i >= 3000 for i in first) >= 19
    again = iso.fit_isolation_forest(df.repartition(7), "id", ["a", "b", "c"], 60)
    assert all(np.array_equal(a, b) for a, b in zip(forest.trees, again.trees))
    # Depths by walking one row down one tree at a time.
    for i in (0, 17, 3005):
        depths = []
        for tree in forest.trees:
            at = 0
            while tree[at][0] >= 0:
                at = int(tree[at][2]) + (0 if data[i][int(tree[at][0])] < tree[at][1] else 1)
            depths.append(tree[at][3])
        assert abs(got[i] - 2 ** (-np.mean(depths) / float(iso.expected_depth(256)))) < 1e-9
    assert iso.fit_isolation_forest(df.limit(0), "id", ["a"]).trees == ()
    flat = spark.createDataFrame([(i, 1.0) for i in range(9)], "id long, a double")
    assert len({x.score for x in iso.isolation_scores(flat, iso.fit_isolation_forest(flat, "id", ["a"], 5)).collect()}) == 1


def test_rows_go_down_trees_as_one_by_one(spark, monkeypatch):
    forest = iso.IsolationForest(("a",), (np.array([(0, 0.5, 1, 0.0), (-1, 0, 0, 1.0), (0, 2.0, 3, 0.0), (-1, 0, 0, 2.0), (-1, 0, 0, 3.0)]), np.array([(-1, 0, 0, 4.0)])), 8)
    monkeypatch.setattr(iso, "ROWS", 2)
    assert forest.depths(np.array([[0.0], [0.5], [2.0], [np.nan], [-np.inf]])).tolist() == [2.5, 3.0, 3.5, 3.5, 2.5]


def test_half_spaces_hold_less_where_nothing_was(spark):
    r = np.random.default_rng(7)
    batch = lambda rows: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "id long, a double, b double")
    model = iso.HalfSpaces(("a", "b"), (0.0, 0.0), (1.0, 1.0), trees=15, depth=7)
    usual = lambda n: np.clip(r.normal(0.3, 0.05, (n, 2)), 0, 1)
    first, second = batch(usual(1500)), batch(np.vstack([usual(300), [[0.95, 0.9], [0.9, 0.05]]]))
    out = iso.half_space_stream([first, second], model)
    assert out[0].where("mass is not null").count() == 0
    got = {x.id: x.mass for x in out[1].collect()}
    assert max(got[300], got[301]) < np.quantile([got[i] for i in range(300)], 0.02)
    masses = model.masses(first)
    whole = {x.tree: x.mass for x in masses.where("cell = 1").collect()}
    assert whole == dict.fromkeys(range(15), 1500)
    assert {x.n for x in masses.where("cell >= 128").groupBy("tree").agg(F.sum("mass").alias("n")).collect()} == {1500}


class PlainTree:
    """The same rules, one row at a time inside a batch."""

    def __init__(self, ranges, classes, bins=10, delta=1e-6, tie=0.05, grace=50):
        self.ranges, self.classes, self.bins, self.delta, self.tie, self.grace = ranges, classes, bins, delta, tie, grace
        self.nodes = [{"rows": [], "checked": 0}]

    def leaf(self, x):
        at = 0
        while "f" in self.nodes[at]:
            n = self.nodes[at]
            at = n["left"] if x[n["f"]] <= n["t"] else n["left"] + 1
        return at

    def learn(self, rows):
        for x, y in rows:
            self.nodes[self.leaf(x)]["rows"].append((x, y))
        for at in range(len(self.nodes)):
            self.split(self.nodes[at])

    def entropy(self, rows):
        n = Counter(y for _, y in rows)
        return -sum(c / len(rows) * math.log2(c / len(rows)) for c in n.values())

    def split(self, node):
        rows = node["rows"]
        if "f" in node or len(rows) - node["checked"] < self.grace:
            return
        node["checked"] = len(rows)
        best = []
        for f, (lo, hi) in enumerate(self.ranges):
            gains = [0.0]
            for b in range(self.bins - 1):
                t = lo + (b + 1) * (hi - lo) / self.bins
                parts = [r for r in rows if r[0][f] <= t], [r for r in rows if r[0][f] > t]
                if all(parts):
                    gains.append(self.entropy(rows) - sum(len(p) * self.entropy(p) for p in parts) / len(rows))
                    if gains[-1] > max(gains[:-1]) + 1e-12:
                        where = t
            best.append((max(gains), -f, where if max(gains) > 0 else None))
        best.sort(key=lambda g: (-g[0], -g[1]))
        bound = math.sqrt(math.log2(len(self.classes)) ** 2 * math.log(1 / self.delta) / (2 * len(rows)))
        if best[0][0] > 0 and (best[0][0] - best[1][0] > bound or bound < self.tie):
            node |= {"f": -best[0][1], "t": best[0][2], "left": len(self.nodes)}
            self.nodes += [{"rows": [], "checked": 0}, {"rows": [], "checked": 0}]


def test_one_tree_from_a_stream_and_from_a_table(spark, tmp_path):
    r = random.Random(9)
    rows = []
    for i in range(6000):
        a, b = r.random(), r.random() * 10
        rows.append((i, a, b, "x" if (a > 0.41) != (b > 6.2) and a > 0.2 or r.random() < 0.02 else "y"))
    schema = "i long, a double, b double, c string"
    made = lambda: hf.HoeffdingTree(["a", "b"], [(0.0, 1.0), (0.0, 10.0)], "c", ["x", "y"])
    plain = PlainTree([(0.0, 1.0), (0.0, 10.0)], ["x", "y"])
    for k in range(6):
        part = rows[k * 1000 : (k + 1) * 1000]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        plain.learn([((a, b), c) for _, a, b, c in part])
    table = hf.grow_from_table(made(), spark.createDataFrame(rows, schema).repartition(5), ["i"], 1000)
    assert len(table.splits()) >= 3
    want = [(n["f"], n["t"], n["left"]) for n in plain.nodes if "f" in n]
    assert [(["a", "b"].index(f), t, left) for _, f, t, left, _ in table.splits()] == want
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    grown = made()
    grown.attach(stream, str(tmp_path / "check")).awaitTermination()
    assert grown.splits() == table.splits()
    hits = table.predict(spark.createDataFrame(rows, schema)).agg(F.avg((F.col("c") == F.col("predicted")).cast("double"))).first()[0]
    assert hits > 0.9
    odd = spark.createDataFrame([(1, None, 1.0, "x"), (2, float("nan"), 1.0, "x"), (3, 0.5, 1.0, None), (4, 0.5, 1.0, "z")], schema)
    before = [n.counts.copy() for n in grown.nodes]
    grown.learn(odd)
    assert all(np.array_equal(a, n.counts) for a, n in zip(before, grown.nodes)) and grown.predict(odd).count() == 4


def test_hidden_states(spark):
    from murmuration.operators import hidden as hm

    r = np.random.default_rng(3)
    true = hm.HiddenMarkov(("a", "b", "c"), np.array([0.9, 0.1]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[0.8, 0.15, 0.05], [0.05, 0.15, 0.8]]))
    rows, states = [], {}
    for key in range(30):
        s = r.choice(2, p=true.start)
        states[key] = []
        for t in range(60):
            states[key].append(s)
            rows.append((key, t, true.symbols[r.choice(3, p=true.emit[s])]))
            s = r.choice(2, p=true.move[s])
    rows += [(0, 1000, None), (77, 0, None)]
    seqs = hm.sequences(spark.createDataFrame(rows, "k long, t long, x string").repartition(4), "k", "x", ["t"])
    model, told = hm.fit_hidden(seqs, 2, 25)
    assert all(b >= a - 1e-6 for a, b in zip(told, told[1:])) and told[-1] > told[0]
    assert np.allclose(model.move.sum(axis=1), 1) and np.allclose(model.emit.sum(axis=1), 1)
    got = {x.k: list(x.states) for x in hm.decode_hidden(seqs, model).collect()}
    hits = np.mean([a == b for k in states for a, b in zip(got[k], states[k])])
    assert max(hits, 1 - hits) > 0.85
    # Likelihood and path by enumeration of all state sequences.
    for seen in ([0], [0, 2, 1], [2, 2, 0, 1, 0]):
        each = {}
        for path in itertools.product((0, 1), repeat=len(seen)):
            p = true.start[path[0]] * true.emit[path[0], seen[0]]
            for t in range(1, len(seen)):
                p *= true.move[path[t - 1], path[t]] * true.emit[path[t], seen[t]]
            each[path] = p
        a, moves, emits, likelihood = true.expected(np.array(seen))
        total = sum(each.values())
        assert abs(likelihood - math.log(total)) < 1e-12 and tuple(true.path(np.array(seen))) == max(each, key=each.get)
        want = np.zeros((2, 2))
        for path, p in each.items():
            for x, y in zip(path, path[1:]):
                want[x, y] += p / total
        assert np.allclose(moves, want) and abs(emits.sum() - len(seen)) < 1e-9
        assert abs(a[0] - sum(p for path, p in each.items() if path[0] == 0) / total) < 1e-12
    assert hm.fit_hidden(seqs.limit(0), 2)[1] == []


def test_rules_of_a_planted_interaction_come_first(spark):
    from murmuration.operators import rules as rl

    r = np.random.default_rng(4)
    x = np.round(r.random((4000, 3)), 2)
    y = 10.0 * ((x[:, 0] >= 0.6) & (x[:, 1] < 0.3)) + r.normal(0, 0.2, 4000)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)] + [(0.5, 0.5, 0.5, None), (None, 0.1, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    model = rl.fit_rules(df, ["a", "b", "c"], "y", trees=5, alpha=0.02)
    first = model.table(spark).first()
    top = next(rule for rule in model.rules if str(rule) == first.rule)
    assert {f for f, _, _ in top.conditions} == {"a", "b"}
    holds = (x[:, 0] >= 0.6) & (x[:, 1] < 0.3)
    for f, sign, t in top.conditions:
        v = x[:, "abc".index(f)]
        assert abs(t - (0.6 if f == "a" else 0.3)) < 0.06 and sign == (">=" if f == "a" else "<")
    error = df.where("y is not null and a is not null").agg(F.avg((F.col("y") - model.column()) ** 2)).first()[0]
    assert error < 0.15 * float(np.var(y)) and abs(first.support - holds.mean()) < 0.05
    assert [str(x) for x in rl.rules_of(("a", 0.5, ("a", 0.2, 1.0, 2.0), 3.0))] == ["a < 0.5", "a < 0.2", "a < 0.5 and a >= 0.2", "a >= 0.5"]
    flat = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, y double")
    assert rl.fit_rules(flat, ["a"], "y").rules == () and rl.fit_rules(flat, ["a"], "y").linear.intercept == 2.0


def test_quantized_search_compares_few_and_finds_most(spark):
    from murmuration.operators import quantizer as qz

    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16)) * 4
    x = centres[r.integers(0, 40, 3000)] + r.normal(size=(3000, 16))
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)] + [(9000, None), (9001, [None] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    model = qz.fit_quantizer(df, "id", "v", 40, 4, 32)
    coded = qz.encode(df, model, "id", "v").cache()
    assert coded.count() == 3000 and {len(c.codes) for c in coded.collect()} == {4}
    ask = df.where("id < 60")
    found = qz.quantized_search(ask, df, coded, model, "id", "v", 5, 3, 80).collect()
    want = {}
    x = np.array([row for _, row in rows[:3000]])
    for i in range(60):
        gap = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        gap[i] = np.inf
        for k, j in enumerate(np.argsort(gap)[:5], 1):
            want[i, int(j)] = (k, gap[j])
    hits = [(f.q, f.id) for f in found if (f.q, f.id) in want]
    assert len(found) == 300 and len(hits) >= 0.9 * 300
    assert all(abs(f.distance - math.dist(x[f.q], x[f.id])) < 1e-6 for f in found)
    size = Counter(c.cell for c in coded.collect())
    met = sum(size[int(c)] for i in range(60) for c in np.argsort(((model.cells - x[i]) ** 2).sum(axis=1))[:3])
    assert met < 0.15 * 60 * 3000
    assert qz.encode(df.limit(0), qz.fit_quantizer(df.limit(0), "id", "v"), "id", "v").count() == 0


def test_quantized_search_sends_on_only_the_best_of_a_slice(spark, monkeypatch):
    from murmuration.operators import quantizer as qz

    r = np.random.default_rng(6)
    rows = [(i, r.integers(0, 3, 4).astype(float).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    model = qz.fit_quantizer(df, "id", "v", 3, 2, 4)
    coded = qz.encode(df, model, "id", "v").cache()
    ask, told = df.where("id % 20 = 0"), {}
    kept = qz.materialize

    def watched(table, name):
        if name == "candidates":
            # What meets in a cell is compared where it stands: no join makes rows of it.
            assert "Join" not in table._jdf.queryExecution().executedPlan().toString()
            told[qz.SLICE] = {(x.q, x.id) for x in table.collect()}
        return kept(table, name)

    monkeypatch.setattr(qz, "materialize", watched)
    for size in (1 << 15, 20):
        monkeypatch.setattr(qz, "SLICE", size)
        qz.quantized_search(ask, df, coded, model, "id", "v", 3, 2, 9).collect()
    x, want = dict(rows), set()
    coded = {c.id: c for c in coded.collect()}
    for q in range(0, 400, 20):
        v = np.array(x[q])
        found = []
        for cell in np.argsort(((model.cells - v) ** 2).sum(axis=1), kind="stable")[:2].tolist():
            table = model.tables(v, cell)
            found += [(table[0][c.codes[0]] + table[1][c.codes[1]], i) for i, c in coded.items() if c.cell == cell and i != q]
        want |= {(q, i) for _, i in sorted(found)[:9]}
    assert told[1 << 15] == want == told[20]


def test_a_louvain_step_leaves_edges_where_they_are(spark):
    from murmuration.store import placed

    r = random.Random(8)
    e = both_ways(spark, [(a, b) for a in range(40) for b in range(a) if r.random() < 0.2]).selectExpr("src", "dst", "1.0D AS w")
    m2 = float(e.count())
    edges = placed(e, "dst")
    assert edges.count() == m2
    state = cm.materialize(e.groupBy("src").count().selectExpr("src AS node", "src AS label", "cast(count AS double) AS k"), "state")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        moved = cm._moved(edges, state, m2, 2, 0)
        lines = moved._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, x in enumerate(lines) if "InMemoryTableScan" in x)
        assert next(x for x in reversed(lines[:scan]) if "Exchange" in x or "Join" in x).count("Join")
        moved = cm.materialize(moved, "moved")
        assert abs(cm._reached(edges, moved, m2) - cm.weighted_modularity(edges, moved.select("node", "label"), m2)) < 1e-12
        assert moved.where("changed").count() and moved.count() == state.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        edges.unpersist()


def test_louvain_goes_on_until_nothing_gains(spark, monkeypatch):
    r = random.Random(5)
    pairs = [(a, b) for a in range(12) for b in range(a) if r.random() < 0.4]
    e = both_ways(spark, pairs)
    rows = [(x.src, x.dst) for x in e.collect()]
    labels, reached = cm.louvain(e)
    told = {x.node: x.label for x in labels.collect()}
    assert len(told) == len({x for p in rows for x in p}) and abs(reached[-1] - modularity(rows, told)) < 1e-9
    # Chance edges: no two communities that gain by becoming one are left.
    for a in set(told.values()):
        for b in set(told.values()) - {a}:
            assert modularity(rows, {n: b if x == a else x for n, x in told.items()}) <= reached[-1] + 1e-9
    for size in (cm.STATE_BYTES, 0):
        monkeypatch.setattr(cm, "STATE_BYTES", size)
        # Nor does a node gain by moving at the end of the first level, by passes or by joins.
        first, reached = cm.louvain(e, 1)
        told = {x.node: x.label for x in first.collect()}
        for n in told:
            assert max(modularity(rows, {**told, n: x}) for x in set(told.values())) <= reached[-1] + 1e-9


def test_the_louvain_query_leaves_no_gain(spark):
    from murmuration.plans import catalog
    from murmuration.plans import relational as rel

    sf = "/root/testdata/sf0.001"
    told = {x.node: x.label for x in catalog.QUERIES["louvain"](spark, sf).collect()}
    rows = [(x.src, x.dst) for x in rel.und(spark, sf).collect()]
    reached = modularity(rows, told)
    for a in set(told.values()):
        for b in set(told.values()) - {a}:
            assert modularity(rows, {n: b if x == a else x for n, x in told.items()}) <= reached + 1e-9
