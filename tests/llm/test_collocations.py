import random
import re
from collections import Counter

import pytest
from fixtures import document_rows, documents, empty

from murmuration.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, max_words, top, cover=100):
    """rows: (lang, text). Every phrase counted by sliding a window over every piece."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    longer = Counter()
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                key = lang, words[i : i + m]
                longer[key] = max(longer[key], a)
    out = []
    for (lang, words), a in candidates.items():
        if 100 * longer[lang, words] >= cover * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], n[lang]))
    seen, ranked = Counter(), []
    for lang, score, a, phrase, left, right, total in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, total, -score))
    return ranked


def result(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def table(spark, rows):
    data = [(i, t, lang, 1, 2) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, words int, score int").repartition(4)


def phrases(seed):
    r = random.Random(seed)
    vocabulary = ["new", "York", "city", "hall", "é", "漢字", "a\x1cb", "Red", "hot", "x"]
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "! ", "\r\n", ";"]
    rows = []
    for _ in range(120):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += ("New York city hall at" if r.random() < 0.15 else r.choice(vocabulary)) + r.choice(ends)
        rows.append((r.choice(["en", "de", None]), text))
    rows += [("en", None), ("fr", ""), ("en", " .,"), ("es", "one two three")] + [rows[3]] * 9
    return rows


@pytest.mark.parametrize("held, block_bytes", [(1_000_000, 1 << 20), (1_000_000, 300), (0, 300), (30, 300)])
def test_equals_brute_force(spark, held, block_bytes):
    rows = phrases(1)
    got = collocations.collocations(table(spark, rows), min_count=6, held=held, block_bytes=block_bytes)
    want = brute(rows, 6, 5, 2000)
    assert len(want) > 60 and any(len(w[2].split(" ")) == 5 for w in want)
    assert result(got) == sorted(want)


def test_options_and_ties(spark):
    rows = phrases(2)
    got = collocations.collocations(table(spark, rows), min_count=4, max_words=3, top=7, cover=60)
    assert result(got) == sorted(brute(rows, 4, 3, 7, 60))


def test_large_products_stay_exact(spark):
    f = spark.range(1).selectExpr("cast(3000000000 as long) a", "cast(90000000000001 as long) n", "cast(3000000007 as long) l", "cast(3000000011 as long) r")
    got = f.selectExpr("cast(cast(a as decimal(19,0)) * 1000 as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s").first().s
    assert got == 1000 * 3000000000 * 90000000000001 // (3000000007 * 3000000011)


def test_awkward_rows(spark):
    texts = [("en", t) for _, t, _ in document_rows()]
    assert result(collocations.collocations(documents(spark), min_count=20)) == sorted(brute(texts, 20, 5, 2000))
    assert collocations.collocations(empty(spark)).count() == 0
    nothing = table(spark, [("en", None), (None, "")])
    assert collocations.collocations(nothing).count() == 0
