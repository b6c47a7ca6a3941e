"""Toxic documents and the sentences that make them so, by multiple-instance learning.

A document is a bag of sentences, and only the bag has a label. A sentence is toxic with a logistic probability of the
words in it; a document is toxic unless all its sentences are clean (noisy-or). Weights are fitted to the likelihood of
the documents' labels, so what the sentences of toxic documents have in common is found without a labelled sentence.

Words speak by themselves and by how they begin, for languages that join and inflect words. Which of these features are
weighed at all is decided by counts over distinct sentences: a passage that many copies repeat counts once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, sized

#: Labelled documents that the model is fitted on, at most: those whose ids hash least. The only bound on what is read.
FIT_TOXIC = 4000
FIT_CLEAN = 8000
#: Features with a weight, at most: the ones that tell most.
FEATURES = 4096
#: Least distinct toxic sentences with a feature, and least log likelihood ratio (chance: 1 in 2,000).
SUPPORT = 3
EVIDENCE = 12.0
PREDICT_FROM = 0.7
RIDGE = 0.02
STEPS = 400

_SENTENCE = re.compile(r"[^.!?…。！？\n]+")
_WORD = re.compile(r"\w+")
_STARTS = (4, 5, 6)
#: A run of more letters is read as text without spaces, in its threes.
_LONG = 24
#: Words whose weight a worker remembers, and the longest such word.
_REMEMBERED, _REMEMBERED_LENGTH = 400_000, 32


def word_features(word: str) -> list[str]:
    """The word, its beginnings, and the threes of a run too long to be a word."""
    out = [word, *(word[:n] + "*" for n in _STARTS if len(word) > n)]
    if len(word) > _LONG:
        out += [f"*{word[i : i + 3]}*" for i in range(len(word) - 2)]
    return out


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, lower-case words) of each sentence with a word; places are code points."""
    for m in _SENTENCE.finditer(text or ""):
        words = _WORD.findall(m.group().lower())
        if words:
            yield m.start(), m.end(), words


@dataclass(frozen=True)
class ToxicityModel:
    """The log odds of a sentence: `bias` and the weights of its words' features."""

    weights: dict[str, float]
    bias: float


class _Weights(dict):
    """What each word adds to the log odds of its sentence; bounded."""

    def __init__(self, model: ToxicityModel):
        self.of = model.weights.get

    def __missing__(self, word: str) -> float:
        total = sum(self.of(f, 0.0) for f in word_features(word))
        if len(word) <= _REMEMBERED_LENGTH:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[word] = total
        return total


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the documents whose labels are never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: tuple[int, int]) -> DataFrame:
    """(toxic, text) of the labelled documents to fit on."""
    per = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    per = per.groupBy(F.col(id_col).alias("_labelled")).agg((F.max(label_col) > 0).alias("toxic"))
    # Ids without a document would waste the bound.
    known = per.join(docs.select(F.col(id_col).alias("_labelled")), "_labelled", "left_semi")
    least = lambda toxic, n: known.where("toxic" if toxic else "not toxic").orderBy(F.xxhash64("_labelled"), "_labelled").limit(n)
    chosen = materialize(least(True, most[0]).unionByName(least(False, most[1])), "labelled")
    texts = docs.select(F.col(id_col).alias("_labelled"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return materialize(texts.join(sized(chosen), "_labelled").select("toxic", "text").distinct(), "labelled-texts")


def _telling(sample: DataFrame, most: int) -> list[str]:
    """The features that distinct toxic sentences have far more often than clean ones."""

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [" ".join(words) for _, _, words in sentences(text)]
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.bool_()), pa.array(found, pa.string())], names=["toxic", "words"])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = Counter(), Counter()
        for batch in batches:
            words, *flags = (c.to_pylist() for c in batch.columns)
            for sentence, *held in zip(words, *flags):
                names = {f for w in sentence.split(" ") for f in word_features(w)}
                for own, n in zip(counts, held):
                    if n:
                        own.update(names)
        names = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)], names=["feature", "t", "c"])

    each = sample.mapInArrow(split, "toxic boolean, words string").groupBy("words")
    each = materialize(each.agg(F.max(F.col("toxic").cast("int")).alias("t"), F.max((~F.col("toxic")).cast("int")).alias("c")), "sentences")
    n = each.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not n.t:
        return []
    share = n.t / (n.t + (n.c or 0))
    sums = each.mapInArrow(count, "feature string, t bigint, c bigint").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    both = F.col("t") + F.col("c")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * max(p, 1e-9)))).otherwise(0.0)
    told = sums.where((F.col("t") >= SUPPORT) & (F.col("t") > both * share)).withColumn("g", 2 * (part("t", share) + part("c", 1 - share)))
    best = told.where(F.col("g") >= EVIDENCE).orderBy(F.desc("g"), "feature").limit(most)
    return [r.feature for r in best.select("feature").collect()]


def _bags(sample: DataFrame, names: list[str]) -> tuple[np.ndarray, ...]:
    """y and the number of plain sentences of each document; its telling sentences as (document, row) and (row, feature)."""
    number = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            plain, hot = [], []
            for text in batch.column(1).to_pylist():
                found = [[number[f] for w in words for f in word_features(w) if f in number] for _, _, words in sentences(text)]
                hot.append([x for x in found if x])
                plain.append(max(1, len(found)) - len(hot[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.int64()), pa.array(hot, pa.list_(pa.list_(pa.int32())))], names=["toxic", "plain", "hot"])

    rows = sample.mapInArrow(run, "toxic boolean, plain bigint, hot array<array<int>>").toArrow()
    hot = rows.column("hot").to_pylist()
    doc = np.array([i for i, d in enumerate(hot) for _ in d], np.int64)
    row = np.array([i for i, s in enumerate(s for d in hot for s in d) for _ in s], np.int64)
    feature = np.array([f for d in hot for s in d for f in s], np.int64)
    return rows.column("toxic").to_numpy().astype(float), rows.column("plain").to_numpy().astype(float), doc, row, feature


def _noisy_or(y, plain, doc, row, feature, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias of greatest penalised likelihood, by gradient steps with running moments.

    With s the sum of -log(1 - p) over the sentences of a document, it is toxic with probability 1 - exp(-s).
    """
    w, b = np.zeros(n_features + 1), -6.0
    w[-1] = b
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = w[-1] + np.bincount(row, w[feature], len(doc))
        s = plain * np.logaddexp(0, w[-1]) + np.bincount(doc, np.logaddexp(0, z), len(y))
        slope = (1 - y) - y / np.expm1(np.clip(s, 1e-9, 500))
        at = slope[doc] / (1 + np.exp(-z))
        grad = RIDGE * w
        grad[:-1] += np.bincount(feature, at[row], n_features)
        grad[-1] = at.sum() + (slope * plain).sum() / (1 + math.exp(-w[-1]))
        grad /= max(1.0, len(y))
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w = w - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w[-1] = np.clip(w[-1], -14, 4)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN, features: int = FEATURES) -> ToxicityModel:
    """The model of the labelled documents that are not held out.

    At most `fit_toxic` and `fit_clean` documents are read, those whose ids hash least; a document with labels of both
    kinds is toxic; null labels and labels of unknown documents say nothing; equal texts count once. Without toxic
    documents no feature is weighed and every sentence is clean.
    """
    sample = _sample(docs, labels, id_col, text_col, label_col, (fit_toxic, fit_clean))
    names = _telling(sample, features)
    bags = _bags(sample, names)
    if not len(bags[0]):
        return ToxicityModel({}, -6.0)
    weights, bias = _noisy_or(*bags, len(names))
    return ToxicityModel({f: float(x) for f, x in zip(names, weights)}, bias)


def _scored(text: str | None, weight: _Weights, bias: float) -> list[tuple[int, int, float]]:
    """(start, stop, log odds) of each sentence; one empty sentence for a text without words."""
    return [(a, b, bias + sum(map(weight.__getitem__, words))) for a, b, words in sentences(text)] or [(0, 0, bias)]


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, score (probability that it is toxic), n_sentences, and place and score of its worst sentence.

    Whole texts are read. Null, empty and blank texts count as one sentence without words, which is clean as far as the
    bias says; of equally bad sentences the first is named. Rows keep their number and nothing is shuffled. An empty
    table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weight = _Weights(model)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = _scored(text, weight, model.bias)
                odds = np.array([z for _, _, z in found])
                worst = int(odds.argmax())
                out.append((-math.expm1(-np.logaddexp(0, odds).sum()), len(found) if found[0][1] else 0, found[worst][0], found[worst][1], math.exp(-np.logaddexp(0, -odds[worst]))))
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds))], names=["doc_id", "score", "n_sentences", "worst_start", "worst_stop", "worst_score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, n_sentences bigint, worst_start bigint, worst_stop bigint, worst_score double")


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop (code points), sentence, score: the sentences that are toxic with at least `threshold`."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weight, least = _Weights(model), math.log(threshold / (1 - threshold))
        for batch in batches:
            out = [(at, a, b, text[a:b], math.exp(-np.logaddexp(0, -z))) for at, text in enumerate(batch.column(1).to_pylist()) for a, b, z in _scored(text, weight, model.bias) if z >= least and b]
            at, *rest = zip(*out) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, kinds))], names=["doc_id", "start", "stop", "sentence", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, stop bigint, sentence string, score double")
