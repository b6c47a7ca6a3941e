import sys
from collections import Counter
from pathlib import Path

import pytest
from fixtures import documents, empty

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from oracle import assert_same  # noqa: E402

from murmuration.llm import chat_format, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_participant_gets_the_dialogue(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b", "yo"), (1, 3, "ann", None),
        (2, 0, "system", "alone"), (3, 1, None, ""), (3, 1, None, ""), (None, 5, "x", "t"), (4, None, "x", "null turn"), (4, 2, "y", "z"),
    ]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, stop int")
    got = chat_format.perspectives(turns).collect()
    dialogues = {}
    for r in sorted(got, key=lambda r: r.position):
        text = dialogues.get((r.conv_id, r.perspective), "")
        assert r.start == len(text) and r.stop - r.start == len(r.segment)
        dialogues[r.conv_id, r.perspective] = text + r.segment
        assert r.masked == (r.role == "assistant") == (r.name == r.perspective)
        inner = (text + r.segment)[r.content_start : r.content_stop]
        assert inner.endswith("<|im_end|>") and inner.count("<|im_end|>") == 1
    assert set(dialogues) == {(1, "ann"), (1, "bob b"), (3, "unknown"), (None, "x"), (4, "x"), (4, "y")}
    assert dialogues[1, "bob b"] == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n"
        "<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    )
    assert chat_format.perspectives(turns.limit(0)).count() == 0


def test_long_conversation_has_gapless_spans(spark):
    turns = spark.range(5000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'a', 'b') AS role", "repeat('x', cast(id % 50 as int)) AS text")
    rows = sorted(chat_format.perspectives(turns).where("perspective = 'a'").collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(5000))
    assert all(a.stop == b.start for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, SF, queries.QUERIES[name], queries.ORACLES[name])


def test_stages_hand_documents_on(spark):
    docs, before = documents(spark), documents(spark).count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents(spark).columns, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert 0 < len(out) <= 3 * before
    nothing = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
    assert nothing.count() == 0


def test_pipeline_equals_brute_force(spark):
    from test_dedup import brute_groups, near_components
    from test_shards_mix_rules import WORD, brute_rules

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = []
    for i, t, s in rows:
        n, chars, symbols, dups, repeats = brute_rules(t)
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        capitals = sum(c.isupper() for c in t)
        if n >= 20 and 100 * repeats <= 30 * n and 10 * symbols <= n and 2 * dups <= lines and 2 * n <= chars <= 20 * n and 5 * capitals <= 4 * chars:
            kept.append((i, t, s))
    stay = {v[0] for v in brute_groups(kept).values()}
    kept = [r for r in kept if r[0] in stay]
    # The probes may miss a link, and never make one: what stays is at least one of each group.
    roots = near_components({i: t for i, t, _ in kept})
    docs = spark.createDataFrame(kept, "doc_id long, text string, source string")
    near = {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()}
    assert set(roots.values()) <= near
    assert len(set(roots) - near) >= 0.9 * (len(roots) - len(set(roots.values())))
    kept = [r for r in kept if r[0] in near]
    times = Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    assert set(times) <= {i for i, _, _ in kept} and max(times.values()) <= 3
    size = {i: len(WORD.findall(t)) for i, t, _ in kept}
    assert abs(sum(size[i] * k for i, k in times.items()) - sum(size.values())) <= max(size.values())


def test_the_last_stage_decodes_as_the_library_does(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    rows = [(i, t, "s") for i, t in enumerate(("two words", "", " spaces  kept ", "\u6f22\u5b57 \U0001f642", "a\x1cb\n\tc"))]
    got = corpus_pipeline.encode(spark, documents(spark, rows), SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.round_trip == (model.decode(list(r.ids)) == rows[r.doc_id][1])
