import re
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import document_rows, documents, empty

from murmuration.llm import mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_are_balanced_and_gapless(spark):
    rows = [(i, f"text {i % 37} " * (i % 11 + 1), "s") for i in range(3000)]
    got = sharding.shards(documents(spark, rows)).collect()
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert len(got) == 3000 and sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 8


def test_shards_of_awkward_rows(spark):
    rows = document_rows()
    text = {i: t for i, t, _ in rows}
    got = sharding.shards(documents(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    # Whole groups stay together unless cutting them is what balance asks for.
    of = defaultdict(set)
    for r in got:
        of[text[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in of.values()) <= 7
    assert sharding.shards(empty(spark)).count() == 0
    assert {r.shard for r in sharding.shards(documents(spark), n_shards=1).collect()} == {0}


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        w = sum(weight[s] for s in names if s not in fixed)
        over = {s: 3 * sizes[s] for s in names if s not in fixed and rest * weight[s] / w > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: fixed.get(s, rest * weight[s] / w if w else 0) for s in names}
        fixed |= over


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 13), f"s{min(i % 17, 5)}" if i % 19 else None) for i in range(4000)] + [(5000, None, "s1"), (5001, "a b", "tiny")]
    got = mixing.mix(documents(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    sizes, taken, target, most = Counter(), Counter(), {}, Counter()
    for r in got:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        most[s] = max(most[s], r.size)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = brute_targets(sizes)
    for s, t in want.items():
        assert abs(target[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 3 * most[s] + 1
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(documents(spark, rows)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


@pytest.mark.parametrize("ids", ["own", "shared", "null"])
def test_mixed_documents_keep_their_shares_whatever_the_ids(spark, ids):
    name = {"own": lambda i: i, "shared": lambda i: i % 7, "null": lambda i: None}[ids]
    source = lambda i: "A" if i < 300 else "B" if i < 400 else "C"
    rows = [(name(i), f"w{i} " + "w " * (9 + i % 2), source(i)) for i in range(430)]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t))
    want = brute_targets(size)
    got = mixing.mixed_documents(documents(spark, rows)).collect()
    words, times = Counter(), Counter()
    for r in got:
        words[r.source] += len(WORD.findall(r.text))
        times[r.text] += 1
    assert max(times.values()) <= 3
    assert all(abs(words[s] - t) <= 3 * 11 + 1 for s, t in want.items())
    assert sum(words.values()) <= sum(size.values())
    # Each row is taken a whole number of passes; within a source none is more than a pass ahead of another.
    for s in size:
        taken = [times[t] for _, t, x in rows if x == s]
        assert max(taken) - min(taken) <= 1


def test_mix_of_awkward_rows(spark):
    got = mixing.mix(documents(spark)).collect()
    text = {i: t for i, t, _ in document_rows()}
    assert len(got) == len(document_rows())
    assert all(r.size == len(WORD.findall(text[r.doc_id] or "")) for r in got)
    assert all(r.taken == 0 for r in got if r.size == 0)
    out = mixing.mixed_documents(documents(spark))
    assert out.columns == documents(spark).columns and out.count() > 0
    assert mixing.mix(empty(spark)).count() == mixing.mixed_documents(empty(spark)).count() == 0


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_ledger_matches_brute_force(spark):
    text = {i: t for i, t, _ in document_rows()}
    got = quality_rules.ledger(documents(spark)).collect()
    assert len(got) == len(document_rows())
    for r in got:
        n, chars, symbols, dups, repeats = brute_rules(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert bool(r.failed & 3) == (n < 20 or 100 * repeats > 30 * n)


def test_policies_and_ablation(spark):
    entries = quality_rules.ledger(documents(spark)).cache()
    rows = entries.collect()
    for name, bits in quality_rules.POLICIES.items():
        mask = quality_rules.mask_of(bits)
        assert entries.where(quality_rules.passes(name)).count() == sum(not r.failed & mask for r in rows)
    mask = quality_rules.mask_of(quality_rules.POLICIES["v2"])
    for a in quality_rules.ablation(entries, "v2").collect():
        bit = next(1 << r.bit for r in quality_rules.RULES if r.name == a.rule)
        assert a.failing == sum(bool(r.failed & bit) for r in rows)
        assert a.failing_alone == sum(r.failed & mask == bit for r in rows)
        assert a.kept_without == sum(not r.failed & mask & ~bit for r in rows)
    kept = quality_rules.apply_policy(documents(spark))
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.failed & mask}
    assert quality_rules.ledger(empty(spark)).count() == quality_rules.apply_policy(empty(spark)).count() == 0
