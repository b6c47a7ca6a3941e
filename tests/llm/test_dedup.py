import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from fixtures import document_rows, documents, empty

from murmuration.llm import components, exact_dedup, simhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("capacity,depth", [(1 << 14, 12), (2, 6)])
def test_exact_groups_match_brute_force(spark, capacity, depth):
    rows = document_rows()
    want = brute_groups(rows)
    got = exact_dedup.exact_groups(documents(spark), capacity=capacity, max_depth=depth).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in got:
        norm = SPACE.sub("", text[r.doc_id] or "")
        assert (r.keep_id, r.group_size) == want[norm]
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
    assert sum(r.kept for r in got) == len(want)


def test_directory_splits_only_overfull_buckets(spark):
    heads = spark.range(4000).selectExpr("xxhash64(id) AS key")
    places, depth = exact_dedup.directory(heads, capacity=100, max_depth=8)
    found = places.collect()
    size = Counter((r.key & (1 << 64) - 1) >> (64 - depth) for r in heads.collect())
    assert sorted(r.place for r in found) == list(range(1 << depth))
    held, width = Counter(), Counter()
    for r in found:
        held[r.bucket, r.local_depth] += size[r.place]
        width[r.bucket, r.local_depth] += 1
    assert all(n <= 100 or d == 8 for (_, d), n in held.items())
    assert all(width[b, d] == 1 << (depth - d) for b, d in held)
    assert 5 <= max(d for _, d in held) == depth <= 7
    # Two halves of a bucket that was split held too much together.
    assert all(n + held[b ^ (1 << (depth - d)), d] > 100 for (b, d), n in held.items() if (b ^ (1 << (depth - d)), d) in held)


def test_buckets_of_one_slot_stop_at_the_last_bit():
    assert exact_dedup.split_buckets([0, 0, 9, 0], 3) == [(0, 1), (2, 2), (3, 2)]
    assert exact_dedup.split_buckets([1], 0) == [(0, 0)]
    assert exact_dedup.split_buckets([0, 0], 0) == [(0, 0)]


def test_hot_groups_join_apart_from_the_rest(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 0.1)
    want = brute_groups(document_rows())
    got = exact_dedup.exact_groups(documents(spark)).collect()
    assert len(got) == len(document_rows())
    text = {i: t for i, t, _ in document_rows()}
    assert all((r.keep_id, r.group_size) == want[SPACE.sub("", text[r.doc_id] or "")] for r in got)
    assert sum(r.kept for r in got) == len(want)


def test_exact_copies_are_dropped_once(spark):
    out = exact_dedup.drop_exact_copies(documents(spark))
    assert out.columns == documents(spark).columns
    norm = [SPACE.sub("", r.text or "") for r in out.collect()]
    assert len(norm) == len(set(norm)) == len(brute_groups(document_rows()))


def brute_fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= distance:
            parent[find(a)] = find(b)
    return [find(i) for i in range(len(fps))]


def test_simhash_groups_match_brute_force(spark):
    rows = document_rows()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    roots = brute_components(fps)
    least = defaultdict(list)
    for (i, _, _), root in zip(rows, roots):
        if i is not None:
            least[root].append(i)
    want = sorted((str(i), f"{f:016x}", str(min(least[r], default=None))) for (i, _, _), f, r in zip(rows, fps, roots))
    got = simhash.near_groups(documents(spark)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("chunk", [1 << 22, 3000])
def test_meetings_find_every_link(chunk):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(400)]
    fps = np.unique(np.array([int(rng.choice(seeds)) ^ f for f in flips], np.uint64))
    pairs = [p for a, b in simhash.meetings(fps, np.full(len(fps), 2), 64, chunk) for p in zip(a.tolist(), b.tolist())]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
    index = {int(f): i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(index[a])] = find(index[b])
    want = brute_components(fps.tolist())
    got = [find(i) for i in range(len(fps))]
    assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_a_dense_cluster_gives_no_more_links_than_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 63))
    fps = {base}
    while len(fps) < 800:
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    values = np.array(sorted(fps), np.uint64)
    for chunk in (1 << 22, 20_000):
        found = list(simhash.meetings(values, np.full(len(values), 2), 64, chunk))
        assert all(len(a) < len(values) for a, _ in found)
    table = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp bigint")
    edges = simhash.links(table)
    # A forest per place: linear in the fingerprints, where all pairs would be 320,000.
    assert edges.count() <= 8 * len(values)
    roots = brute_components(values.tolist())
    labels = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert len({labels.get(int(x), int(x)) for x in values.view(np.int64)}) == len(set(roots))


def test_a_forest_spans_and_has_no_circle():
    rng = np.random.default_rng(6)
    for n, m in ((1, 0), (2, 5), (50, 40), (50, 400), (300, 5000)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        kept = simhash.forest(a, b, n)
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a[kept].tolist(), b[kept].tolist()):
            assert find(x) != find(y)
            parent[find(x)] = find(y)
        assert all(find(x) == find(y) for x, y in zip(a.tolist(), b.tolist()))


def test_reach_covers_the_ball(spark):
    fps = spark.createDataFrame([(0,), (-1,), (12345678901234567,)], "fp long")
    rows = simhash.reach(fps, prefix=8, radius=2).collect()
    assert len(rows) == 3 * 37
    assert all(r.left == 2 - bin(r.place ^ ((r.fp & (1 << 64) - 1) >> 56)).count("1") for r in rows)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[k] == 1 for k in (1, *range(200, 260)))


def near_components(texts, n=5, threshold=0.8):
    """doc_id -> smallest doc_id reachable over pairs of similar shingle sets."""

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}

    sets = {i: shingles(t or "") for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common >= threshold * (len(sets[a]) + len(sets[b]) - common):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def test_near_copies_leave_one(spark):
    import random

    r = random.Random(4)
    rows = []
    for k in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(300)]
        for c in range(4):
            w = list(base)
            for at in r.sample(range(300), 3 * c):
                w[at] = f"n{r.randrange(10**6)}"
            rows.append((k * 10 + c, " ".join(w), "s"))
    want = near_components({i: t for i, t, _ in rows})
    kept = {x.doc_id for x in simhash.drop_near_copies(documents(spark, rows)).collect()}
    assert set(want.values()) <= kept
    assert len(set(want) - kept) >= 0.9 * (len(want) - len(set(want.values())))


def test_near_copies_of_awkward_rows(spark):
    out = simhash.drop_near_copies(documents(spark)).collect()
    text = {i: t for i, t, _ in document_rows()}
    assert sum(r.text == text[0] for r in out) == 1
    assert any(r.doc_id is None for r in out)


def test_empty_tables(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert simhash.near_groups(empty(spark)).count() == 0
    assert exact_dedup.drop_exact_copies(empty(spark)).count() == 0
    assert simhash.drop_near_copies(empty(spark)).count() == 0


def test_the_prefix_grows_with_the_fingerprints_and_changes_no_link(spark):
    assert simhash.prefix_bits(0) == simhash.prefix_bits(1_000_000) == simhash.PREFIX_BITS
    bits = [simhash.prefix_bits(10**n) for n in range(6, 11)]
    assert bits == sorted(bits) and bits[-1] > bits[0]
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base ^ np.uint64(1 << 62) ^ (np.uint64(1) << rng.integers(0, 62, 40, dtype=np.uint64))
    fps = spark.createDataFrame([(int(x),) for x in {*base.tolist(), *near.tolist()}], "fp bigint")
    few, many = ({tuple(r) for r in simhash.links(fps, prefix=p).collect()} for p in (8, 13))
    assert few == many and len(few) >= 40


def sentences(seed, count, words=12):
    import random

    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(3000)}" for _ in range(words)) for _ in range(count)]


def test_near_copies_of_a_class_that_only_share_its_words(spark):
    rows, want = [], set()
    for k in range(10):
        s = sentences(100 + k, 40, 4)
        # All three have the same words; only A and B have the same shingles.
        head, a, b = s[1::2] + s[::2], s, s[1:] + s[:1]
        rows += [(10 * k + i, " ".join(t), "s") for i, t in ((1, head), (2, a), (3, b))]
        want |= {10 * k + 1, 10 * k + 2}
    assert set(near_components({i: t for i, t, _ in rows}).values()) == want
    assert {r.doc_id for r in simhash.drop_near_copies(documents(spark, rows)).collect()} == want


def test_near_copies_with_a_part_cut_appended_or_edited(spark):
    import random

    r, rows = random.Random(8), []
    for k in range(60):
        base = " ".join(sentences(200 + k, r.choice((5, 20, 60)))).split()
        cut = base[: -(len(base) * 16 // 100)]
        edited = list(base)
        edited[len(base) // 2] = "new"
        rows += [(10 * k + i, " ".join(w), "s") for i, w in enumerate((base, cut, edited))]
    want = near_components({i: t for i, t, _ in rows})
    assert len(set(want.values())) == 60
    assert {x.doc_id for x in simhash.drop_near_copies(documents(spark, rows)).collect()} == set(want.values())


def test_a_crowd_of_near_copies_with_outliers_matches_brute_force(spark):
    import random

    r, base, rows = random.Random(9), " ".join(sentences(300, 20)).split(), []
    for i in range(150):
        w = list(base)
        for at in r.sample(range(len(w)), r.choice((1, 2, 4, 12, 14))):
            w[at] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "s"))
    want = near_components({i: t for i, t, _ in rows})
    assert {x.doc_id for x in simhash.drop_near_copies(documents(spark, rows)).collect()} == set(want.values())


def test_edited_copies_that_are_near_nothing_are_not_compared_with_the_crowd(spark, monkeypatch):
    import random

    from murmuration.llm import near_choice

    r, base, rows = random.Random(10), " ".join(sentences(310, 12)).split(), []
    for i in range(300):
        w = list(base)
        for at in r.sample(range(len(w)), r.choice((0, 1, 2, 5, 8, 12, 20, 30))):
            w[at] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "s"))
    judged, write = [], near_choice.materialize

    def seen(df, name):
        out = write(df, name)
        if name == "near-judged":
            judged.append(out.count())
        return out

    monkeypatch.setattr(near_choice, "materialize", seen)
    want = near_components({i: t for i, t, _ in rows})
    assert {x.doc_id for x in simhash.drop_near_copies(documents(spark, rows)).collect()} == set(want.values())
    assert sum(judged) < 20 * len(rows)


def test_shared_shingles_are_counted(spark):
    from murmuration.llm import near_choice

    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 4]), (3, [5]), (4, [2, 3, 4])], "doc_id long, s array<long>")
    assert sorted(map(tuple, near_choice.shared_counts(sets).collect())) == [(1, 3, 2), (2, 2, 2), (3, 1, 0), (4, 3, 3)]


def test_rows_without_or_with_one_id_are_decided_by_their_texts(spark):
    from murmuration.llm import quality_rules

    texts = [" ".join(sentences(400 + i, 8)) for i in range(8)]
    rows = [(None, t, "s") for t in texts[:3]] + [(7, t, "s") for t in texts[3:6]] + [(7, "too short", "s"), (None, "too short", "s"), (8, texts[6], "s"), (8, texts[6], "s")]
    for stage, left in (
        (exact_dedup.drop_exact_copies, {*texts[:7], "too short"}),
        (simhash.drop_near_copies, {*texts[:7], "too short"}),
        (quality_rules.apply_policy, {*texts[:7]}),
    ):
        docs = documents(spark, rows)
        got = [r.text for r in stage(docs).collect()]
        assert set(got) == left, stage
        assert docs.columns == stage(docs).columns
