import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import document_rows, documents, empty
from pyspark.sql import functions as F

from murmuration.llm import pieces, token_files

BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_token_files_hold_what_the_library_encodes(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    rows = document_rows()
    manifest = token_files.write_tokens(documents(spark), BPE)
    got = token_files.read_tokens(manifest).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert r.start == at and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_files.read_tokens(token_files.write_tokens(empty(spark), BPE)).count() == 0


def test_rows_of_one_id_have_one_order(spark):
    rows = [(5, f"text number {i}", "s") for i in range(30)] + [(1, "first", "s"), (9, "last", "s")]
    found = []
    for parts in (2, 7):
        got = token_files.read_tokens(token_files.write_tokens(documents(spark, rows).repartition(parts), BPE)).collect()
        found.append(sorted((r.start, r.doc_id, r.ids_crc32) for r in got))
    assert found[0] == found[1]


def test_token_files_are_flat_integers(spark):
    row = token_files.write_tokens(documents(spark), BPE).orderBy("part").first()
    tokens = np.memmap(row.path.removeprefix("file:") + ".bin", row.dtype, "r")
    offsets = np.fromfile(row.path.removeprefix("file:") + ".idx", "<i8")
    assert row.dtype == "<u2" and len(tokens) == offsets[-1] == row.n_tokens and row.base == 0


def test_pieces_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=SPM)
    text = {i: t or "" for i, t, _ in document_rows()}
    got = pieces.decode(pieces.encode(documents(spark), SPM, round_trip=True), SPM).collect()
    assert len(got) == len(document_rows())
    for r in got:
        want = model.encode(text[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want)
        assert r.round_trip and r.decoded == model.decode(want) == text[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<i4").tobytes())
    assert pieces.encode(empty(spark), SPM).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(none, SPM).first().decoded == ""


def test_a_word_without_a_stable_split_is_merged(monkeypatch):
    model = pieces.PieceModel(SPM)
    want = model.split("▁internationalization")
    monkeypatch.setattr(model, "_relax_bpe", lambda word, last, strange: None)
    assert model.split("▁internationalization") == want


@pytest.mark.parametrize("word", ["▁the", "▁internationalization", "漢é▁", "", "aaaaaaa", "▁▁▁x"])
def test_unigram_split_is_the_best_by_exhaustion(word):
    model = pieces._model(SPM, "unigram")

    def best(w):
        if not w:
            return 0.0
        options = [model.score[w[:k]] + best(w[k:]) for k in range(1, min(16, len(w)) + 1) if w[:k] in model.score]
        if w[0] not in model.score:
            options.append(model.lowest + best(w[1:]))
        return max(options)

    parts = [model.text(i) for i in model.split(word)]
    assert "".join(parts) == word
    if len(word) < 14:
        assert sum(model.score.get(p, model.lowest) for p in parts) == pytest.approx(best(word))


def test_word_memory_survives_generations():
    from murmuration.llm.chunks import Memory

    memory = Memory(lambda words: [w.upper() for w in words], size=10)
    for i in range(40):
        memory.prepare({f"w{i}", "often"})
        assert memory.young[f"w{i}"] == f"W{i}" and memory.young["often"] == "OFTEN"
    assert len(memory.young) + len(memory.old) < 30
    assert F is not None


def test_memory_is_bounded_in_bytes_and_forgets_long_strings():
    from murmuration.llm.chunks import LONGEST, Memory

    asked = []

    def encode(strings):
        asked.extend(strings)
        return [s.encode() for s in strings]

    memory = Memory(encode, size=10_000, most=20_000)
    for k in range(50):
        needed = {f"word{k}-{i}" for i in range(60)} | {"x" * 5000 + str(k), "漢" * 300, "common"}
        memory.prepare(needed)
        assert all(memory.young[s] == s.encode() for s in needed)
        assert memory.bytes <= 20_000 + 60 * 250
        assert sum(len(s) > LONGEST for s in memory.young) == 2 and not any(len(s) > LONGEST for s in memory.old)
    assert asked.count("common") < 10 and asked.count("漢" * 300) == 50
    assert len(memory.young) + len(memory.old) < 400
