"""Whitening of embeddings by their leading principal components, found by LOBPCG.

The covariance matrix is never formed. A block of directions is multiplied with it by one pass over the centred rows,
whose parts Spark sums; the Rayleigh-Ritz step works on the span of the iterate, its residual and the direction last
taken, with small matrices whose size depends on the dimension alone. The passes end when every residual is certified to
be as small as double precision allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

COMPONENTS = 4
#: Directions iterated beside the wanted ones: they take over what lies close to the last wanted eigenvalue.
GUARDS = 8
#: A pair is certified when its residual is below this share of the greatest eigenvalue.
RESIDUAL = 1e-13
#: Passes in which no residual shrinks to half are the end of what rounding allows; this many end the iteration.
STALLED = 4
MOST_PASSES = 500
SCALE = 256
_FLAT = 1e-12  # eigenvalues below this share of the trace are rounding


@dataclass(frozen=True)
class Fit:
    """The fit list's size and sums, and its leading pairs: certified residuals beside them."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # a row for each component
    residuals: np.ndarray
    passes: int


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): rows whose vector has neither null nor non-finite entries, x = floor(scale * entry) as longs."""
    entry = lambda v: v.cast("double")
    finite = lambda v: v.isNotNull() & ~F.isnan(entry(v)) & (F.abs(entry(v)) < float("inf"))
    whole = embeddings.where(F.col(vector_col).isNotNull() & F.forall(vector_col, finite))
    return whole.select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda v: F.floor(entry(v) * scale).cast("long")).alias("x"))


def _rows(column, dimensions: int) -> np.ndarray:
    """An Arrow column of long lists as a matrix; shorter lists end in zeros."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dimensions).all():
        return flat.reshape(len(lengths), dimensions)
    out = np.zeros((len(lengths), dimensions), np.int64)
    out[np.arange(dimensions) < lengths[:, None]] = flat
    return out


def _summed(rows: DataFrame, dimensions: int, shape: tuple[int, int], of) -> np.ndarray:
    """The sum of of(matrix of rows) over all rows: each task adds up its own, Spark the tasks' by row of the result."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(shape)
        for batch in batches:
            total += of(_rows(batch.column(0), dimensions))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.select("x").mapInArrow(run, "i long, row array<double>")
    sums = parts.groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(shape[1])]).alias("row"))
    out = np.zeros(shape)
    for r in sums.collect():
        out[r.i] = r.row
    return out


def _orthonormal(x: np.ndarray, blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of what the blocks' columns add to those of x (orthonormal), up to rounding."""
    basis, least = x, 1e-10
    for block in blocks:
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
            lengths = np.linalg.norm(block, axis=0)
            block = block[:, lengths > least] / lengths[lengths > least]
        if block.shape[1]:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            u = u[:, s > least]
            basis = np.hstack([basis, np.linalg.qr(u - basis @ (basis.T @ u))[0]])
    return basis[:, x.shape[1] :]


def lobpcg(multiply, dimensions: int, wanted: int, guards: int = GUARDS, residual: float = RESIDUAL, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The `wanted` greatest eigenvalues of a symmetric operator, falling; vectors as rows; residual norms; passes.

    `multiply(block)` gives the operator's product with a block of columns: the one distributed step, taken once a round
    for the new directions only. Products with the iterate and the last direction are combined from earlier ones.
    """
    width = min(dimensions, wanted + guards)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, width)))[0]
    products, passes, best, stalled, fresh = multiply(basis), 1, np.inf, 0, True
    while True:
        inner = basis.T @ products
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        x, ax = basis @ turn, products @ turn
        r = ax - x * values
        norms = np.linalg.norm(r, axis=0)
        worst, least = norms[:wanted].max(), residual * max(values[0], 0)
        stalled = 0 if worst < best / 2 else stalled + 1
        best = min(best, worst)
        done = worst <= least or stalled >= STALLED and worst <= 1e3 * least or passes >= MOST_PASSES
        if done and fresh:
            return values[:wanted], x[:, :wanted].T, norms[:wanted], passes
        # The direction taken: what of the new iterate came from outside the old one.
        outside = turn.copy()
        outside[:width] = 0
        new = _orthonormal(x, [r / np.maximum(norms, 1e-300), basis @ outside])
        fresh = done or not new.shape[1]
        if fresh:
            # Combined products have gathered rounding: the end is certified with products made anew.
            basis = np.linalg.qr(x)[0]
            products = multiply(basis)
        else:
            basis, products = np.hstack([x, new]), np.hstack([ax, multiply(new)])
        passes += 1


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """The fit list: every vector once, shorter ones with zeros at their end; written so that each pass reads the same rows."""
    least, most = vectors.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    x = F.col("x")
    if least != most:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x")))
    return materialize(vectors.select(x.alias("x")).distinct(), "distinct-vectors")


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit:
    """The leading components of the covariance of `distinct_vectors` (divisor n).

    Vectors of unequal length are read as ending in zeros. Components whose eigenvalue is zero within rounding are left
    out, so there are fewer than `components` of few dimensions or vectors; none of an empty table.
    """
    n, dimensions = distinct.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not dimensions:
        return Fit(n, [0] * dimensions, 0.0, np.zeros(0), np.zeros((0, dimensions)), np.zeros(0), 0)
    per = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"))
    sums = [0] * dimensions
    for r in per.collect():
        sums[r.i] = int(r.s)
    mean = np.array([s / n for s in sums])
    trace = float(_summed(distinct, dimensions, (1, 1), lambda x: np.array([[((x - mean) ** 2).sum()]]))[0, 0]) / n
    if trace == 0:
        return Fit(n, sums, 0.0, np.zeros(0), np.zeros((0, dimensions)), np.zeros(0), 0)

    def multiply(block: np.ndarray) -> np.ndarray:
        def product(x):
            centred = x - mean
            return centred.T @ (centred @ block)

        return _summed(distinct, dimensions, block.shape, product) / n

    values, found, residuals, passes = lobpcg(multiply, dimensions, min(components, dimensions))
    real = values > _FLAT * trace
    return Fit(n, sums, trace, values[real], found[real], residuals[real], passes)


def identity_error(distinct: DataFrame, fitted: Fit) -> float | None:
    """The greatest entry of the whitened fit list's covariance minus the identity, by one more pass."""
    k, dimensions = len(fitted.values), len(fitted.sums)
    if not k:
        return None
    mean, project = np.array([s / fitted.n for s in fitted.sums]), (fitted.vectors / np.sqrt(fitted.values)[:, None]).T

    def moments(x):
        z = (x - mean) @ project
        return np.vstack([z.sum(axis=0), z.T @ z])

    m = _summed(distinct, dimensions, (k + 1, k), moments) / fitted.n
    return float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(k)).max())


def whiten(vectors: DataFrame, fitted: Fit) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, residual for each row of `integer_vectors` and component.

    `deviation` is the exact sum over dimensions of (n x - S)^2, null where that passes 64 bits. A vector's rows have the
    same values wherever it stands, and copies have their own rows; ids may be null or repeat.
    """
    n, k, dimensions = fitted.n, len(fitted.values), len(fitted.sums)
    exact = np.array(fitted.sums, dtype=object)
    mean, project = np.array([s / max(n, 1) for s in fitted.sums]), (fitted.vectors / np.sqrt(fitted.values)[:, None]).T
    share = fitted.values / fitted.trace if fitted.trace else fitted.values
    fits = all(abs(s) < 1 << 62 for s in fitted.sums)

    def deviations(x: np.ndarray) -> list:
        most = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in fitted.sums), default=0)
        if fits and most * most * max(dimensions, 1) < 1 << 63:
            return (((n * x) - np.array(fitted.sums, np.int64)) ** 2).sum(axis=1).tolist()
        found = [sum(int(v) ** 2 for v in n * row.astype(object) - exact) for row in x]
        return [v if v < 1 << 63 else None for v in found]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _rows(batch.column(1), dimensions)
            z, rows = (x - mean) @ project, np.repeat(np.arange(len(x)), k)
            far = deviations(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n, np.int64)),
                    pa.array([v for v in far for _ in range(k)], pa.int64()), pa.array(z.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.tile(fitted.residuals, len(x))),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "residual"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, residual double")


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every usable row of the table whitened by the leading components, with the error of the whole whitening.

    Rows whose vector is null or holds a null or non-finite entry are dropped; shorter vectors are read as ending in
    zeros; equal vectors are fitted once. Tables without spread, and empty ones, give no rows. Other columns are not read.
    """
    vectors = materialize(integer_vectors(embeddings, id_col, vector_col), "vectors")
    distinct = distinct_vectors(vectors)
    fitted = fit(distinct, components)
    return whiten(vectors, fitted).withColumn("identity_error", F.lit(identity_error(distinct, fitted)).cast("double"))
