import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import document_rows, documents, empty
from pyspark.sql import functions as F

from murmuration.llm import html_extract, language_model
from murmuration.llm.html_blocks import blocks
from murmuration.llm.queries import held_out


def test_scores_of_the_base_model_match_brute_force(spark):
    rows = document_rows()
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t, _ in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows}
    counts = Counter(w for i, _, _ in rows if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    got = language_model.score_documents(documents(spark), held_out()).collect()
    assert len(got) == len(rows)
    for r in got:
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id])
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known) == (len(tokens[r.doc_id]), sum(counts[w] > 0 for w in tokens[r.doc_id]))
        assert r.train_tokens == n and r.held_out == held[r.doc_id] and r.score < 0


def test_reruns_agree_and_rare_pairs_join(spark, monkeypatch):
    docs = documents(spark)
    first = {(r.doc_id, round(r.score, 6)) for r in language_model.score_documents(docs, held_out()).collect()}
    few = language_model.hot_pairs
    monkeypatch.setattr(language_model, "hot_pairs", lambda scores: few(scores, most=20))
    again = {(r.doc_id, round(r.score, 6)) for r in language_model.score_documents(docs, held_out()).collect()}
    assert first == again
    assert language_model.score_documents(empty(spark), held_out()).count() == 0
    none = language_model.score_documents(docs, F.lit(True)).first()
    assert none.train_tokens == 0 and none.n_known == 0 and math.isfinite(none.score)


def test_pairs_of_documents_travel_in_arrays(spark, monkeypatch):
    docs = documents(spark)
    few = language_model.hot_pairs
    monkeypatch.setattr(language_model, "hot_pairs", lambda scores: few(scores, most=20))
    found = []
    for buckets in (1, 37):
        monkeypatch.setattr(language_model, "LEAST_BUCKETS", buckets)
        scored = language_model.score_documents(docs, held_out())
        # No pair of a document is a row: nothing is unfolded, and no join meets pairs.
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
        found.append(sorted(str((r.doc_id, r.n_known, round(r.score, 6), round(r.base_score, 6))) for r in scored.collect()))
    assert found[0] == found[1] and len(found[0]) == len(document_rows())


CORPUS = ["a b a b a c", "a b b a b", "b c d a b a b", "c d c d c d a", "a", "x y a b", "a b a c d", "b b b b a b"]
ASIDE = ["a b c q", "d a q b", ""]


def counted(texts):
    """The word table of some texts as one batch, and the pairs in its order."""
    import pyarrow as pa

    train = Counter()
    for words, contexts in language_model.Reader().read(texts):
        train.update(zip(words.tolist(), contexts.tolist()))
    names = sorted({w for w, _ in train})
    pairs = [(w, u) for w in names for u in sorted(u for x, u in train if x == w)]
    sizes = [sum(w == n for w, _ in pairs) for n in names]
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    counts = [train[p] for p in pairs]
    arrays = [pa.array(np.array(names, np.uint64).view(np.int64))]
    for values in ([u for _, u in pairs], counts, counts, [1] * len(pairs)):
        arrays.append(pa.ListArray.from_arrays(ends, pa.array(values)))
    return pa.RecordBatch.from_arrays(arrays, names=["w", "u", "train", "n", "t"]), pairs


def totals_of(s, discounts=None):
    m = language_model
    c1, c0 = s.received(s.t, s.group, s.group_class), s.received(s.t1, s.group_word, s.w)
    guess = tuple(m._discount((c == 1).sum(), (c == 2).sum()) for c in (s.train, c1, c0))
    by_u, by_k = (lambda x: np.bincount(s.u, weights=x, minlength=m.CONTEXTS)), (lambda x: np.bincount(s.group_class, weights=x, minlength=m.CLASSES))
    return m.Totals((by_u(s.train), by_k(c1), c0.sum()), (by_u(s.t), by_k(s.t1), s.t0.sum()), discounts or guess, int((s.t0 > 0).sum()))


def sampled(texts, burn_in, samples, settings=language_model.Settings()):
    """Pair -> averaged probability, by sweeps over one batch."""
    batch, pairs = counted(texts)
    s = language_model.Seating(batch)
    totals, mean = totals_of(s), 0.0
    for step in range(burn_in + samples):
        if step >= burn_in:
            mean = mean + s.likely(totals, settings) / samples
        s.sweep(totals, settings, step)
        totals = totals_of(s, totals.discounts)
    return dict(zip(pairs, mean)), s, totals


def one_by_one(texts, discounts, burn_in, samples, seed=3):
    """(word, previous word) -> averaged probability, by a sampler that moves one customer at a time."""
    import random

    r = random.Random(seed)
    tokens = [(w, p) for t in texts for w, p in zip([*t.split(), ""], [None, *t.split()])]
    known = {w for w, _ in tokens}
    seats = {}

    def up(room):
        return None if room == "root" else "root" if room[0] == "class" else ("class", room[1][-1:] if room[1] is not None else None)

    def level(room):
        return 2 if room == "root" else 1 if room[0] == "class" else 0

    def chance(room, w):
        if room is None:
            return 1 / (len(known) + 1)
        d, here = discounts[level(room)], seats.setdefault(room, {})
        c, t = sum(map(sum, here.values())), sum(map(len, here.values()))
        own = here.get(w, [])
        return (sum(own) - d * len(own) + (1 + d * t) * chance(up(room), w)) / (1 + c)

    def add(room, w):
        if room is None:
            return
        d, here = discounts[level(room)], seats.setdefault(room, {})
        own, t = here.setdefault(w, []), sum(map(len, here.values()))
        k = r.choices(range(len(own) + 1), [n - d for n in own] + [(1 + d * t) * chance(up(room), w)])[0]
        if k == len(own):
            own.append(1)
            add(up(room), w)
        else:
            own[k] += 1

    def leave(room, w):
        if room is None:
            return
        own = seats[room][w]
        k = r.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            leave(up(room), w)

    for w, p in tokens:
        add(("word", p), w)
    mean = Counter()
    for step in range(burn_in + samples):
        for w, p in tokens:
            leave(("word", p), w)
            add(("word", p), w)
        if step >= burn_in:
            for w, p in set(tokens):
                mean[w, p] += chance(("word", p), w) / samples
    return mean


def test_probabilities_of_a_context_sum_to_one():
    m, settings = language_model, language_model.Settings()
    words = sorted({w for t in CORPUS for w in t.split()} | {""})
    texts = [*CORPUS, *[f"a {w}" if w else "a" for w in words]]
    _, s, totals = sampled(texts, 3, 1)
    heard = m.Reader()
    after = next(iter(heard.read(["a"])))[1][1]
    seen = s.u == after
    # All words follow `a` here, so what is left is the share of the unknown word.
    d, c, t = totals.discounts, totals.customers, totals.tables
    kind = int(after) // m.SLOTS
    unknown = 1 / (totals.known + 1)
    for level, at in ((2, None), (1, kind), (0, int(after))):
        cc, tt = (c[level], t[level]) if at is None else (c[level][at], t[level][at])
        unknown *= (1 + d[level] * tt) / (1 + cc)
    assert seen.sum() == len(words)
    assert math.isclose(s.likely(totals, settings)[seen].sum() + unknown, 1.0, rel_tol=1e-9)


def test_sweeps_agree_with_moving_customers_one_by_one():
    got, _, totals = sampled(CORPUS, 50, 400)
    want = one_by_one(CORPUS, totals.discounts, 50, 600)
    reader, ids = language_model.Reader(), {}
    for text in CORPUS:
        for (w, u), pair in zip(zip(*map(np.ndarray.tolist, next(iter(reader.read([text]))))), zip([*text.split(), ""], [None, *text.split()])):
            ids[pair] = (w, u)
    assert len(ids) == len(got) == len(want)
    error = [abs(math.log(got[ids[p]] / want[p])) for p in want]
    assert max(error) < 0.25 and sum(error) / len(error) < 0.06


def test_scores_are_sums_over_the_sampled_chain(spark):
    rows = [(i, t, "s") for i, t in enumerate([*CORPUS, *ASIDE])]
    held = F.col("doc_id") >= len(CORPUS)
    got = {r.doc_id: r.score for r in language_model.score_documents(documents(spark, rows), held).collect()}
    likely, s, _ = sampled(CORPUS, 2, 2)
    for i, text in enumerate(CORPUS):
        (words, contexts), = language_model.Reader().read([text])
        assert math.isclose(got[i], sum(math.log10(likely[p]) for p in zip(words.tolist(), contexts.tolist())), rel_tol=1e-5)
    assert all(math.isfinite(got[i]) and got[i] < 0 for i in range(len(CORPUS), len(rows)))


def test_every_preceding_word_has_a_room_of_its_own(spark, monkeypatch):
    m = language_model
    slots = {}
    for i in range(100_000):
        word = f"w{i}e"
        slot = int(next(iter(m.Reader().read([word])))[1][1])
        if slot in slots:
            break
        slots[slot] = word
    x, y = slots[slot], word
    texts = [f"{x} p", f"{y} q"] * 6 + ["p q", "q p"]
    rows = [(i, t, "s") for i, t in enumerate([*texts, f"{x} p", f"{x} q", f"{y} p", f"{y} q"])]
    found = []
    for block in (m.BLOCK, 1):
        monkeypatch.setattr(m, "BLOCK", block)
        scored = m.score_documents(documents(spark, rows), F.col("doc_id") >= len(texts)).collect()
        found.append({r.doc_id - len(texts): r.score for r in scored})
    # Where rooms are shared both words follow either alike.
    assert found[0][0] > found[0][1] + 0.3 and found[0][3] > found[0][2] + 0.3
    assert all(math.isclose(v, found[1][i], rel_tol=1e-6) for i, v in found[0].items())


def test_partitions_do_not_change_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = []
    for parts in (3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append({r.doc_id: r.score for r in language_model.score_documents(docs.repartition(parts), held_out()).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert all(math.isclose(x, found[1][i], rel_tol=1e-6) for i, x in found[0].items())


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    scored = language_model.score_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), held_out()).cache()
    assert language_model.perplexity(scored) < 0.9 * language_model.perplexity(scored, "base_score")


def test_numbers_of_tables_follow_their_distribution():
    rng = np.random.default_rng(3)
    d, a = 0.5, 2.0
    assert (language_model.draw(np.array([0.0, 1.0, 2.0]), np.ones(3), d, np.array([0.5, 0.5, 0.99])) == [0, 1, 2]).all()
    for c in (3, 40, 128):
        logs = language_model.stirling(d)[c, 1 : c + 1] + np.log(a) * np.arange(1, c + 1)
        share = np.exp(logs - logs.max())
        mean = (share * np.arange(1, c + 1)).sum() / share.sum()
        got = language_model.draw(np.full(20000, float(c)), np.full(20000, a), d, rng.random(20000)).mean()
        assert abs(got - mean) < 0.03 * mean
    # S(3, t) by hand: (1 - d)(2 - d), 3 (1 - d), 1.
    assert np.allclose(np.exp(language_model.stirling(d)[3, 1:4]), [0.75, 1.5, 1.0])


def test_large_parties_are_seated_as_in_turn():
    rng = np.random.default_rng(3)
    n, a, d = 400, 2.0, 0.5
    want = []
    for _ in range(1000):
        t = 1
        for c in range(1, n):
            t += rng.random() < a / (c - d * t + a)
        want.append(t)
    got = language_model.draw(np.full(1000, float(n)), np.full(1000, a), d, rng.random(1000))
    assert abs(got.mean() - np.mean(want)) < 0.05 * np.mean(want)


def test_blocks_of_broken_markup():
    found = blocks("<title>t</title><body><nav><a href=x>Home</a></nav><article><h1>A &amp;  b</h1><p>one<br>two<p>three <b>four</article><script>if(a<b){}</script><footer>&copy; x")
    assert [b.text for b in found] == ["Home", "A & b", "one two", "three four", "© x"]
    assert found[0].linked == 4 and "article" in found[2].tags and found[2].own == "p"
    assert blocks(None) == blocks("") == blocks("<p> \n</p>") == []


def test_held_out_pages_are_labelled_well():
    model = html_extract.default_model()
    wrong = total = 0
    for chain, labels in html_extract.training_data(150, seed=99):
        assert len(chain) == len(labels)
        wrong += sum(a != b for a, b in zip(model.decode(chain), labels))
        total += len(labels)
    assert wrong < 0.02 * total


def test_unknown_containers_and_parts_of_an_article():
    model = html_extract.default_model()
    text = "A sentence of some length stands here. Another one follows it."
    for tag, name in (("div", "inhalt"), ("section", "x7"), ("div", "corps-texte")):
        page = f'<body><nav><a href=x>Home</a></nav><div class="{name}"><h1>Title of it</h1><p>{text}</p><p>{text}</p></div><footer>&copy; x</footer></body>'
        assert html_extract.main_text(page, model) == f"Title of it\n\n{text}\n\n{text}", tag
    page = f"<body><article><header><p>by someone</p></header><h1>Title of it</h1><p>{text}</p><footer><p>Tags: x y</p></footer></article></body>"
    assert html_extract.main_text(page, model) == f"Title of it\n\n{text}"
    assert html_extract.main_text(f"<article><p>{text}</p><!-- oops <p>gone</p></article>", model) == text


def test_notices_and_comments_of_unknown_names_go():
    model = html_extract.default_model()
    text = "It was a long day in the harbour, and nobody had seen the ship come in. They waited."
    want = f"Title of it\n\n{text}\n\n{text}"
    body = f"<h1>Title of it</h1><p>{text}</p><p>{text}</p>"
    notice = "<div id='gdpr' role='dialog'><p>We use cookies and similar technologies to improve the site.</p><button>OK</button></div>"
    entries = "".join(f"<div class='k'><b>{n}</b><p>{t}</p></div>" for n, t in (("Anna", "Sehr schön, danke dafür."), ("Otto", "Das finde ich nicht gut.")))
    for page in (
        f"{notice}<main>{body}</main>",
        f"<main>{body}<div class='kommentare'><h3>Kommentare</h3>{entries}</div></main>",
        f"<main>{body}<div class='kommentare'><p>Sehr schön, danke dafür. Das war es.</p><p>Das finde ich nicht gut.</p></div></main>",
        f"<body>{notice}<div class='inhalt'>{body}</div></body>",
    ):
        assert html_extract.main_text(page, model) == want, page
    plain = [c for c, _ in html_extract.training_data(60, seed=31)[60:]]
    assert not any(f.startswith("name:") for c in plain for b in c for f in b)


@pytest.mark.parametrize("part", ["<div class=a{}>x", "<span>y<p>x", "<div><p>x y z a b c d.</section>", "<head><body>x<i>", "<li><ul>x</b>"])
def test_time_grows_in_proportion_to_the_page(part):
    model = html_extract.default_model()

    def seconds(n):
        page = "".join(part.replace("{}", str(i)) for i in range(n))
        began = time.process_time()
        html_extract.main_text(page, model)
        return time.process_time() - began

    assert seconds(16_000) < 4 and seconds(64_000) < 16


def test_viterbi_is_the_best_by_exhaustion():
    from itertools import product

    model = html_extract.default_model()
    for chain, _ in html_extract.training_data(40, seed=77):
        chain = chain[:10]
        node = [sum(model.weights.get(f, 0.0) for f in b) for b in chain]

        def score(labels):
            pairs = sum(model.pairs[a][b] for a, b in zip(labels, labels[1:]))
            return pairs + sum(n for n, y in zip(node, labels) if y)

        best = max(product((0, 1), repeat=len(chain)), key=score)
        assert math.isclose(score(model.decode(chain)), score(best), rel_tol=1e-9, abs_tol=1e-9)


def test_extraction_of_pages(spark):
    long = "word " * 40000
    html = f"<html><body><div class='ad'><p>Buy it.</p></div><article><h1>Title here</h1><p>First  text.</p><p>{long}</p></article><div class='comments'><p>Nice one!</p></div></body></html>"
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (None, "u", "<nav><a href=x>Home</a></nav>"), (1, "u", html)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = html_extract.extract(pages).collect()
    assert len(got) == 5
    for r in got:
        want = f"Title here\n\nFirst text.\n\n{long.strip()}" if r.page_id == 1 else ""
        assert r.text == want and r.n_chars == len(want)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_pages_of_the_test_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        body = html[r.page_id]
        inner = body[body.index("<article>") : body.index("</article>")].replace("<br>", " ")
        from html import unescape

        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", p))).strip() for p in re.split(r"</?(?:p|h1|article)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p)
