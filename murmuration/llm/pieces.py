"""SentencePiece encoding and decoding with one Aho-Corasick pass per word.

An automaton over all pieces reads a word once; at each position its output links name the pieces that end there, and
each of them is relaxed from the best split before it. For a unigram model the best split has the greatest sum of
scores. A BPE model's scores are merge ranks, whose sum means nothing: there the split kept at a position is the one
that merging would leave, that is the one whose last two pieces are stable, do not merge otherwise when set side by
side. Stability is decided by the ranks for each pair of pieces once and remembered.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memory

MARK = "▁"
#: Stable pairs remembered by a worker.
PAIRS = 500_000
GROUP = 128


def word_pattern(pieces) -> re.Pattern | None:
    """Where a normalized text can be cut: between two characters that no piece holds side by side.

    Runs of letters are cut from what is no letter, and marks stay with what follows them. Letters that some piece
    joins with a non-letter count as non-letters. None if a piece holds a mark after another character.
    """
    odd = ""
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        return None
    while True:
        letter = re.compile(rf"[^\W\d_{odd}]")
        joined = {a if letter.match(a) else b for p in pieces for a, b in zip(p, p[1:]) if MARK not in (a, b) and bool(letter.match(a)) != bool(letter.match(b))}
        if not joined:
            return re.compile(rf"{MARK}*(?:[^\W\d_{odd}]+|(?:[\d_{odd}]|[^\w{MARK}])+)|{MARK}+")
        odd += "".join(map(re.escape, sorted(joined)))


class PieceModel:
    """A SentencePiece model file, with its own normalizer and vocabulary."""

    def __init__(self, path: str, kind: str = "bpe"):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        if kind not in ("bpe", "unigram"):
            raise ValueError("kind must be bpe or unigram")
        self.kind, self.model = kind, SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.raw = [b""] * size
        for i in range(size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif self.model.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not (self.model.is_control(i) or self.model.is_unused(i)):
                self.ids[piece] = i
                self.raw[i] = piece.replace(MARK, " ").encode()
        self.score = {p: self.model.get_score(i) for p, i in self.ids.items()}
        self.lowest = min(self.score.values(), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.words = word_pattern(self.ids)
        self.size = size
        self.piece = {i: p for p, i in self.ids.items()}
        self.single = frozenset(p for p in self.ids if len(p) == 1)
        self.stable: dict[int, bool] = {}
        self.memory = Memory(lambda words: map(self.encode_word, words))

    def merge(self, symbols: str) -> list[str]:
        """Byte-pair merging by rank, leftmost first among equals."""
        parts: list[str | None] = list(symbols)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts):
                both = parts[i] + parts[j]
                rank = self.score.get(both)
                if rank is not None:
                    heappush(queue, (-rank, i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        heapify(queue)
        while queue:
            _, i, j, both = heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def is_stable(self, a: int, b: int) -> bool:
        """Whether two pieces (a character outside the vocabulary is size + its code) stay as they are side by side."""
        key = a * (self.size + 0x110000) + b
        found = self.stable.get(key)
        if found is None:
            if len(self.stable) > PAIRS:
                self.stable.clear()
            left, right = self.text(a), self.text(b)
            found = self.stable[key] = self.merge(left + right) == [x for x in (left, right) if x]
        return found

    def text(self, i: int) -> str:
        """A piece, or the character that stands outside the vocabulary; -1 is nothing."""
        return "" if i < 0 else self.piece[i] if i < self.size else chr(i - self.size)

    def split(self, word: str) -> list[int]:
        """The pieces of a word, in one pass; characters outside the vocabulary stand alone.

        Should no stable split be found, a BPE word is merged from its characters instead.
        """
        n = len(word)
        last, strange = [-1] * (n + 1), not self.single.issuperset(word)
        relax = self._relax_unigram if self.kind == "unigram" else self._relax_bpe
        relax(word, last, [i for i in range(n) if word[i] not in self.single] if strange else [])
        out, i = [], n
        while i:
            piece = last[i]
            if piece < 0:
                return [self.ids[p] if p in self.ids else self.size + ord(p) for p in self.merge(word)]
            out.append(piece)
            i -= len(self.piece[piece]) if piece < self.size else 1
        return out[::-1]

    def _relax_bpe(self, word: str, last: list[int], strange: list[int]) -> None:
        stable, width, alone = self.stable, self.size + 0x110000, -1 * (self.size + 0x110000)
        at = 0
        for end, (piece, size) in self.automaton.iter(word):
            while at < len(strange) and strange[at] < end:
                self._stand_alone(word, last, strange[at])
                at += 1
            if last[end + 1] >= 0:
                continue
            start = end + 1 - size
            before = last[start]
            if start and before < 0:
                continue
            found = stable.get(before * width + piece if start else alone + piece)
            if found if found is not None else self.is_stable(before, piece):
                last[end + 1] = piece
        for i in strange[at:]:
            self._stand_alone(word, last, i)

    def _stand_alone(self, word: str, last: list[int], i: int) -> None:
        code = self.size + ord(word[i])
        if last[i + 1] < 0 and (i == 0 or last[i] >= 0 and self.is_stable(last[i], code)):
            last[i + 1] = code

    def _relax_unigram(self, word: str, last: list[int], strange: list[int]) -> None:
        best = [0.0] + [-np.inf] * len(word)
        at = 0

        def stand_alone(i: int) -> None:
            if best[i] + self.lowest > best[i + 1]:
                best[i + 1], last[i + 1] = best[i] + self.lowest, self.size + ord(word[i])

        for end, (piece, size) in self.automaton.iter(word):
            while at < len(strange) and strange[at] < end:
                stand_alone(strange[at])
                at += 1
            value = best[end + 1 - size] + self.score[self.piece[piece]]
            if value > best[end + 1]:
                best[end + 1], last[end + 1] = value, piece
        for i in strange[at:]:
            stand_alone(i)

    def encode_word(self, word: str) -> bytes:
        found = self.split(word)
        if max(found, default=0) >= self.size:
            found = [j for i in found for j in ([i] if i < self.size else self.fallback(chr(i - self.size)))]
        return array("i", found).tobytes()

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.model.unk_id()]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, as 32-bit integers."""
        words = [self.words.findall(n) if self.words else [n] * bool(n) for n in self.model.normalize([t or "" for t in texts])]
        self.memory.prepare(set().union(*words))
        known = self.memory.young
        return [b"".join(map(known.__getitem__, w)) for w in words]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; broken byte sequences become replacement characters."""
        raw = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


_models: dict[tuple[str, str], PieceModel] = {}


def _model(path: str, kind: str) -> PieceModel:
    if (path, kind) not in _models:
        _models[path, kind] = PieceModel(path, kind)
    return _models[path, kind]


def encode(
    docs: DataFrame, model_path: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False
) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers) for every row.

    With `round_trip` also `round_trip`: whether decoding the ids, in the same pass, gives the text back. Null text
    counts as empty and has no ids. Texts are encoded whole. Rows keep their number and partitioning; nothing is
    shuffled. Other columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = _model(model_path, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                texts = some.column(1).to_pylist()
                data = model.encode(texts)
                sizes = np.array([len(d) // 4 for d in data], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out = {
                    "doc_id": some.column(0),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), "<i4"))),
                    "n_tokens": pa.array(sizes.astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(d) for d in data], pa.int64()),
                }
                if round_trip:
                    same = [model.decode(np.frombuffer(d, "<i4").tolist()) == t for d, t in zip(data, texts, strict=True)]
                    out["round_trip"] = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_pydict(out)

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, ids array<int>, n_tokens bigint, ids_crc32 bigint" + ", round_trip boolean" * round_trip
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, kind: str = "bpe") -> DataFrame:
    """Adds `decoded`, the text of the column `ids`; null ids decode to the empty text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = _model(model_path, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                ids = some.column(some.schema.get_field_index("ids"))
                texts = [model.decode(ids[i].values.to_numpy().tolist() if ids[i].is_valid else []) for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*some.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded string")
