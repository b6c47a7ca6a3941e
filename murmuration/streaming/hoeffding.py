"""A decision tree that grows from a stream: leaves hold counts of class by feature and bin, and split once they are sure.

A batch is routed to the leaves by the tree as a column expression, and counted by leaf, feature, bin and class in one
aggregate. Only those counts come to the driver: their number depends on leaves, features, bins and classes, not on the
rows. A leaf splits at the best bin border when its lead in information gain over the second best feature exceeds the
Hoeffding bound, or when the bound says that the lead no longer matters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class _Node:
    counts: np.ndarray  # features x bins x classes
    checked: int = 0
    feature: int = -1
    threshold: float = 0.0
    children: tuple[int, int] = (-1, -1)
    #: Classes that the parent sent here, so that a leaf without rows of its own has an answer.
    inherited: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of the class counts in the last axis."""
    total = counts.sum(axis=-1, keepdims=True)
    p = counts / np.maximum(total, 1)
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=-1)


class HoeffdingTree:
    """A tree over numeric features with known ranges. `learn` takes a batch; `attach` takes all batches of a stream.

    Rows that lack a feature or a class, and classes that were not named, are not learned from. A leaf is looked at when
    `grace` rows have come to it since it was last; batches are learned whole, so splits fall between batches.
    """

    def __init__(self, features: list[str], ranges: list[tuple[float, float]], label: str, classes: list, delta: float = 1e-6, tie: float = 0.05, grace: int = 50, bins: int = 10, most_leaves: int = 256):
        self.features, self.ranges, self.label, self.classes = features, ranges, label, classes
        self.delta, self.tie, self.grace, self.bins, self.most_leaves = delta, tie, grace, bins, most_leaves
        self.nodes = [self._leaf(np.zeros(len(classes)))]

    def _leaf(self, inherited: np.ndarray) -> _Node:
        return _Node(np.zeros((len(self.features), self.bins, len(self.classes)), np.int64), inherited=inherited)

    def _at(self, found, at: int = 0) -> Column:
        """The leaf of a row, as `found` tells it, by nested conditions."""
        node = self.nodes[at]
        if node.feature < 0:
            return F.lit(found(at))
        left, right = (self._at(found, c) for c in node.children)
        return F.when(F.col(self.features[node.feature]).cast("double") <= node.threshold, left).otherwise(right)

    def _bin(self, f: int) -> Column:
        low, high = self.ranges[f]
        width = (high - low) / self.bins or 1.0
        # Bins are closed above, so that rows at a border go where a split at it would send them.
        at = F.ceil((F.col(self.features[f]).cast("double") - low) / width).cast("int") - 1
        return F.greatest(F.least(at, F.lit(self.bins - 1)), F.lit(0))

    def learn(self, batch: DataFrame) -> list[int]:
        """Counts a batch and splits the leaves that are sure; the places of the nodes that were split."""
        whole = batch
        for c in (*self.features, self.label):
            whole = whole.where(F.col(c).isNotNull())
        for f in self.features:
            whole = whole.where(~F.isnan(F.col(f).cast("double")))
        cells = F.array(*[F.struct(F.lit(f).alias("f"), self._bin(f).alias("bin")) for f in range(len(self.features))])
        number = {c: i for i, c in enumerate(self.classes)}
        flat = whole.where(F.col(self.label).isin(self.classes)).select(self._at(lambda at: at).alias("leaf"), F.col(self.label).alias("y"), F.explode(cells).alias("c"))
        for r in flat.groupBy("leaf", "c.f", "c.bin", "y").agg(F.count("*").alias("n")).collect():
            self.nodes[r.leaf].counts[r.f, r.bin, number[r.y]] += r.n
        return [at for at in range(len(self.nodes)) if self._try_split(at)]

    def _try_split(self, at: int) -> bool:
        node = self.nodes[at]
        if node.feature >= 0:
            return False
        seen = int(node.counts[0].sum())
        if seen - node.checked < self.grace or sum(n.feature < 0 for n in self.nodes) >= self.most_leaves:
            return False
        node.checked = seen
        classes = node.counts[0].sum(axis=0)
        left = np.cumsum(node.counts, axis=1)[:, :-1]
        right = classes - left
        nl, nr = left.sum(axis=2), right.sum(axis=2)
        gain = np.where((nl > 0) & (nr > 0), _entropy(classes) - (nl * _entropy(left) + nr * _entropy(right)) / seen, 0.0)
        border = gain.argmax(axis=1)
        best = gain.max(axis=1)
        order = np.argsort(-best, kind="stable")
        lead = best[order[0]] - (best[order[1]] if len(order) > 1 else 0.0)
        bound = math.sqrt(math.log2(max(len(self.classes), 2)) ** 2 * math.log(1 / self.delta) / (2 * seen))
        if best[order[0]] <= 0 or not (lead > bound or bound < self.tie):
            return False
        f, b = int(order[0]), int(border[order[0]])
        low, high = self.ranges[f]
        node.feature, node.threshold = f, low + (b + 1) * ((high - low) / self.bins or 1.0)
        node.children = (len(self.nodes), len(self.nodes) + 1)
        self.nodes += [self._leaf(left[f, b]), self._leaf(right[f, b])]
        node.counts = node.counts[:0]
        return True

    def _class_of(self, at: int):
        counts = self.nodes[at].counts[0].sum(axis=0)
        told = counts if counts.sum() else self.nodes[at].inherited
        return self.classes[int(np.argmax(told))]

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Adds the commonest class of each row's leaf; a row that lacks a feature goes right where it is asked for."""
        return df.withColumn(out, self._at(self._class_of))

    def splits(self) -> list[tuple[int, str, float, int, int]]:
        """(node, feature, threshold, left, right) of every split, as they were made."""
        return [(i, self.features[n.feature], n.threshold, *n.children) for i, n in enumerate(self.nodes) if n.feature >= 0]

    def attach(self, stream: DataFrame, checkpoint: str):
        """Learns from every micro-batch of a stream; the running query. The tree lives in the driver.

        A micro-batch that is given again after a failure is told by its number and not counted twice.
        """
        done = set()

        def take(batch: DataFrame, number: int) -> None:
            if number not in done:
                self.learn(batch)
                done.add(number)

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grow_from_table(tree: HoeffdingTree, df: DataFrame, order: list, batch_rows: int) -> HoeffdingTree:
    """The tree after a table's rows in order, `batch_rows` at a time."""
    from ..operators.ordering import numbered
    from ..store import materialize

    rows = materialize(numbered(df, order).withColumn("_batch", F.floor(F.col("_at") / batch_rows)), "batches")
    for k in range((rows.agg(F.max("_batch")).first()[0] or 0) + 1):
        tree.learn(rows.where(F.col("_batch") == k))
    return tree
