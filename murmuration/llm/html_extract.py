"""The main text of web pages, by a linear-chain conditional random field over leaf blocks.

A page's blocks make a chain; each is the article's own (1) or not (0). The features are ancestor tags, words in the
ancestors' class, id and role, and the look of the text. The model is trained on labelled pages by stochastic gradient
on the chain's log likelihood, and decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import blocks, features
from .labelled_pages import labelled_pages

#: Labelled pages the model is fitted on; a fixed number, whatever the table.
TRAINING_PAGES = 800
EPOCHS = 12
GROUP = 64


@dataclass(frozen=True)
class ChainModel:
    """Weights of each feature for label 1 (label 0 is the reference), and of label pairs."""

    weights: dict[str, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]

    @cached_property
    def names(self) -> frozenset[str]:
        """The words of class and id that the model knows: pages need no others."""
        return frozenset(f[5:] for f in self.weights if f.startswith("name:"))

    def decode(self, chain: list[list[str]]) -> list[int]:
        """The likeliest labels of a page, by Viterbi."""
        if not chain:
            return []
        get, (to0, to1) = self.weights.get, tuple(zip(*self.pairs))
        off, on, back = 0.0, sum(get(f, 0.0) for f in chain[0]), []
        for names in chain[1:]:
            score = sum(get(f, 0.0) for f in names)
            from0, from1 = (off + to0[0], on + to0[1]), (off + to1[0], on + to1[1])
            back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
            off, on = max(from0), max(from1) + score
        label = int(on > off)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> ChainModel:
    """Train on (features of each block, label of each block) pages. Gradients are expected minus observed counts."""
    names: dict[str, int] = {}
    data = [([[names.setdefault(f, len(names)) for f in b] for b in chain], np.array(y)) for chain, y in pages if chain]
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    squares_w, squares_t = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            chain, y = data[k]
            n = len(chain)
            node = np.zeros((n, 2))
            node[:, 1] = [w[b].sum() for b in chain]
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = node[0]
            for i in range(1, n):
                forward[i] = node[i] + np.logaddexp(forward[i - 1, 0] + t[0], forward[i - 1, 1] + t[1])
            for i in range(n - 2, -1, -1):
                ahead = node[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(t[:, 0] + ahead[0], t[:, 1] + ahead[1])
            total = np.logaddexp(*forward[-1])
            on = np.exp(forward[:, 1] + backward[:, 1] - total)
            grad_t = np.zeros((2, 2))
            for i in range(1, n):
                grad_t += np.exp(forward[i - 1][:, None] + t + (node[i] + backward[i])[None, :] - total)
                grad_t[y[i - 1], y[i]] -= 1
            grad_w = decay * w
            for b, g in zip(chain, on - y):
                grad_w[b] += g
            squares_w += grad_w**2
            squares_t += grad_t**2
            w -= rate * grad_w / np.sqrt(squares_w)
            t -= rate * grad_t / np.sqrt(squares_t)
    return ChainModel({f: float(w[i]) for f, i in names.items()}, tuple(map(tuple, t.tolist())))


def training_data(count: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    """Every page as it is, and every second one also without the words of its class and id."""
    pages = [(blocks(html), labels) for html, labels in labelled_pages(count, seed)]
    named = [([features(b) for b in found], labels) for found, labels in pages]
    return named + [([features(b, named=False) for b in found], labels) for found, labels in pages[::2]]


@lru_cache(maxsize=1)
def default_model() -> ChainModel:
    """Fitted once per driver process on the bounded set of labelled pages."""
    return fit(training_data(TRAINING_PAGES, seed=1))


def main_text(html: str | None, model: ChainModel) -> str:
    found = blocks(html, model.names)
    labels = model.decode([features(b) for b in found])
    return "\n\n".join(b.text for b, y in zip(found, labels) if y)


def extract(pages: DataFrame, model: ChainModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row.

    Null or empty html, and pages without an article, have the empty text. Whole pages are read, whatever their
    length; broken markup is read as browsers would close it. Rows keep their number; nothing is shuffled. Other
    columns are not read.
    """
    chain = model or default_model()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                texts = [main_text(h, chain) for h in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars bigint")
