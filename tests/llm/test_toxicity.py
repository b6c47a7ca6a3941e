import math
import random
import zlib

import numpy as np
from fixtures import document_rows, documents, empty, words

from murmuration.llm import toxicity


def corpus(n=900, seed=3):
    """(id, text, toxic): one sentence of a toxic text has a bad word, or one with a bad beginning."""
    r = random.Random(seed)
    bad = ["grolk", "vazzi", "plimton", "zorkelig"]
    rows = []
    for i in range(n):
        lines = [words(r, r.randint(4, 12)).split(" ") for _ in range(r.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 2)):
                word = r.choice(bad) if r.random() < 0.7 else "zorke" + words(r, 1)
                r.choice(lines).insert(1, word.capitalize() if r.random() < 0.3 else word)
        rows.append((i, ". ".join(" ".join(x) for x in lines) + r.choice([".", "!", ""]), int(toxic)))
    return rows


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def fitted(spark, rows, **options):
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return toxicity.fit(documents(spark, [(i, t, "s") for i, t, _ in rows]), labels, **options)


def test_held_out_documents_are_told_apart_and_sentences_found(spark):
    rows = corpus()
    model = fitted(spark, rows)
    docs = documents(spark, [(i, t, "s") for i, t, _ in rows])
    scores = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in scores if is_held_out(i)]
    assert len(held) > 200
    assert sum((scores[i].score >= 0.7) != bool(truth[i]) for i in held) <= 0.03 * len(held)
    found = toxicity.offending_sentences(docs, model).collect()
    text = {i: t for i, t, _ in rows}
    assert all(text[r.doc_id][r.start : r.stop] == r.sentence for r in found)
    named = [r for r in found if any(b in r.sentence.lower() for b in ("grolk", "vazzi", "plimton", "zorke"))]
    assert len(named) >= 0.95 * len(found) and {r.doc_id for r in named} >= {i for i in held if scores[i].score >= 0.7 and truth[i]}


def test_scores_are_the_noisy_or_of_sentences(spark):
    model = toxicity.ToxicityModel({"bad": 7.0, "wors*": 3.0, "*xyz*": 2.0}, -6.0)
    p = lambda z: 1 / (1 + math.exp(-z))
    long = "xyz" + "a" * 30
    cases = [
        (1, "A bad day. Nothing here! BAD worse", 1 - (1 - p(1)) * (1 - p(-6)) * (1 - p(4)), 3, "BAD worse"),
        (2, None, p(-6), 0, ""), (3, "", p(-6), 0, ""), (4, " . !\n", p(-6), 0, ""),
        (5, "worst", p(-3), 1, "worst"), (6, "wors", p(-6), 1, "wors"), (7, long, p(-4), 1, long), (None, "bad", p(1), 1, "bad"),
        (8, "bad\nbad", 1 - (1 - p(1)) ** 2, 2, "bad"),
    ]
    docs = documents(spark, [(i, t, "s") for i, t, *_ in cases])
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    for i, t, score, n, worst in cases:
        r = got[i]
        assert abs(r.score - score) < 1e-12 and r.n_sentences == n
        assert (t or "")[r.worst_start : r.worst_stop].strip() == worst
    assert got[8].worst_start == 0


def test_gradient_steps_reach_the_greatest_likelihood():
    r = np.random.default_rng(1)
    y, plain = np.array([1, 1, 0, 0, 1, 0, 1, 0] * 5, float), r.integers(1, 6, 40).astype(float)
    doc = np.sort(r.integers(0, 40, 60))
    row = np.arange(60)
    feature = np.where(y[doc] == 1, r.integers(0, 2, 60), r.integers(1, 3, 60))
    w, b = toxicity._noisy_or(y, plain, doc, row, feature, 3)

    def loss(w, b):
        s = plain * np.log1p(math.exp(b)) + np.bincount(doc, np.log1p(np.exp(b + w[feature])), 40)
        return -(y * np.log(-np.expm1(-s)) - (1 - y) * s).sum() + toxicity.RIDGE / 2 * ((w**2).sum() + b**2)

    best = loss(w, b)
    for i in range(4):
        for step in (-0.02, 0.02):
            moved = np.append(w, b)
            moved[i] += step
            assert loss(moved[:3], moved[3]) > best - 1e-3


def test_awkward_tables(spark):
    rows = document_rows()
    docs = documents(spark)
    labels = spark.createDataFrame([(3, 1), (3, 0), (100, None), (None, 1), (9999, 1), (0, 0), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(empty(spark), model).count() == 0
    assert toxicity.offending_sentences(empty(spark), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert nothing.weights == {} and max(r.score for r in toxicity.score_documents(docs, nothing).where("n_sentences < 3").collect()) < 0.01
    assert toxicity.fit(empty(spark), labels).weights == {}
    clean = toxicity.fit(docs, labels.where("toxic = 0"))
    assert clean.weights == {} and clean.bias < -6


def test_the_bound_takes_the_same_documents_each_time(spark):
    rows = corpus(400, 5)
    a, b = (fitted(spark, r, fit_toxic=40, fit_clean=60) for r in (rows, rows[::-1]))
    assert a.weights.keys() == b.weights.keys() and abs(a.bias - b.bias) < 1e-6
    assert all(abs(a.weights[f] - b.weights[f]) < 1e-6 for f in a.weights)


def test_very_unlikely_sentences_score_zero(spark):
    """A long sentence of words that speak against it has odds below what exp can hold."""
    model = toxicity.ToxicityModel({"mild": -2.0, "bad": 3.0}, -6.0)
    docs = spark.createDataFrame([(1, "mild " * 400), (2, "bad bad bad. "), (3, None), (4, "bad " * 400)], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert rows[1].score == rows[1].worst_score == 0.0
    assert rows[4].score == rows[4].worst_score == 1.0
    assert 0.9 < rows[2].score < 1.0 and 0.0 < rows[3].score < 0.01
    assert sorted(r.doc_id for r in toxicity.offending_sentences(docs, model, 1e-12).collect()) == [2, 4]
