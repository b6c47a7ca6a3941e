"""Factors of long sparse matrices: truncated singular values, non-negative factors, latent semantic analysis.

A matrix is a table (row, col, value) of its entries; duplicates add up. A thin dense matrix is a table of a key and an array of
k doubles. The one large step is their product, a join on the shared key and a sum for each key of the other side; small
k x k matrices are sums over a thin table and come to the driver.

Where one direction of a thin matrix over the columns has at most THIN_BYTES, counted first, it travels with the job instead: each
row of the matrix is gathered once, and meets it where it stands. As many directions go with a pass as fit THIN_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import gathered, materialize, sized
from .ordering import numbered

#: Bytes of a thin matrix, or some directions of it, that travel with a job; entries that a task multiplies at a time.
THIN_BYTES, ENTRIES = 24 << 20, 1 << 19


def multiply(entries: DataFrame, thin: DataFrame, of: str, by: str, k: int) -> DataFrame:
    """(of, vector): the matrix times a thin one (by, vector); `of` and `by` are row and col, or col and row."""
    met = entries.join(thin, by)
    sums = met.groupBy(of).agg(*[F.sum(F.col("value") * F.col("vector")[j]).alias(f"v{j}") for j in range(k)])
    return sums.select(of, F.array(*[f"v{j}" for j in range(k)]).alias("vector"))


def gram(thin: DataFrame, k: int) -> np.ndarray:
    """The k x k products of a thin table's columns."""
    v = F.col("vector")
    found = thin.agg(*[F.coalesce(F.sum(v[i] * v[j]), F.lit(0.0)) for i in range(k) for j in range(i, k)]).first()
    out, at = np.zeros((k, k)), iter(found)
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = next(at)
    return out


def turned(vector: Column, matrix: np.ndarray) -> Column:
    """A row vector times a small matrix."""
    n, m = matrix.shape
    return F.array(*[sum((vector[i] * float(matrix[i, j]) for i in range(1, n)), vector[0] * float(matrix[0, j])) for j in range(m)])


def orthonormal(thin: DataFrame, key: str, k: int) -> tuple[DataFrame, int]:
    """The thin table's columns made orthonormal, twice over by their Gram matrix; directions within rounding go."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(gram(thin, k))
        real = values > 1e-13 * max(values[-1], 1e-300)
        k = int(real.sum())
        if not k:
            return thin.limit(0), 0
        thin = materialize(thin.select(key, turned(F.col("vector"), vectors[:, real] / np.sqrt(values[real])).alias("vector")), "basis")
    return thin, k


def _parts(batch) -> Iterator[tuple]:
    """(start, end, place of each entry's row, columns, values) of some rows of a batch at a time."""
    offsets = batch.column(1).offsets.to_numpy().astype(np.int64)
    at, value = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
    offsets = offsets - offsets[0]
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + ENTRIES, "right")) - 1)
        of = slice(offsets[start], offsets[end])
        yield start, end, np.repeat(np.arange(end - start), np.diff(offsets[start : end + 1])), at[of], value[of]
        start = end


def _times(thin: np.ndarray, place: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Some rows times a thin matrix."""
    return np.stack([np.bincount(place, value * thin[j][at], n) for j in range(len(thin))])


def _groups(k: int, size: int) -> Iterator[slice]:
    """Directions that travel together."""
    step = max(1, THIN_BYTES // (8 * max(1, size)))
    return (slice(start, min(k, start + step)) for start in range(0, k, step))


def _passed(rows: DataFrame, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """With y = the matrix times `thin` (k x columns): y'y, the transposed matrix times y (columns x k), and which columns have entries."""
    groups = list(_groups(*thin.shape))
    if len(groups) == 1:
        return _pass(rows, thin)
    out, met = np.zeros(thin.shape[::-1]), np.zeros(thin.shape[1], bool)
    for of in groups:
        _, out[:, of], some = _pass(rows, thin[of])
        met |= some
    square = thin @ out
    return (square + square.T) / 2, out, met


def _pass(rows: DataFrame, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """With y = the matrix times `thin` (k x columns): y'y, the transposed matrix times y (columns x k), and which columns have entries.

    Sums are made in the tasks; a task gives on one row for each column that it has met.
    """
    k, size = thin.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, square, met = np.zeros((k, size)), np.zeros((k, k)), np.zeros(size, bool)
        for batch in batches:
            for start, end, place, at, value in _parts(batch):
                y = _times(thin, place, at, value, end - start)
                square += y @ y.T
                met[at] = True
                for j in range(k):
                    total[j] += np.bincount(at, value * y[j][place], size)
        used = np.flatnonzero(met)
        if len(used):
            at = np.concatenate([-1 - np.arange(k), used]).astype(np.int32)
            flat = np.concatenate([square, total[:, used].T]).ravel()
            for s in range(0, len(at), 8192):
                some = at[s : s + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * k, pa.array(flat[s * k : (s + len(some)) * k]))], names=["at", "v"])

    sums = gathered(rows.mapInArrow(run, "at int, v array<double>").groupBy("at").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(k)]).alias("v")))
    at = sums.column("at").to_numpy()
    v = sums.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    square, out, met = np.zeros((k, k)), np.zeros((size, k)), np.zeros(size, bool)
    square[-1 - at[at < 0]] = v[at < 0]
    out[at[at >= 0]], met[at[at >= 0]] = v[at >= 0], True
    return square, out, met


def _turn(square: np.ndarray) -> np.ndarray:
    """What makes columns of these products orthonormal; directions within rounding go."""
    values, vectors = np.linalg.eigh(square)
    real = values > 1e-13 * max(values[-1], 1e-300)
    return vectors[:, real] / np.sqrt(values[real])


def _rows_times(rows: DataFrame, thin: np.ndarray, turn: np.ndarray) -> DataFrame:
    """(row, vector): the rows times a thin matrix (k x columns), times a small one."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, end, place, at, value in _parts(batch):
                y = _times(thin, place, at, value, end - start).T @ turn
                ends = np.arange(end - start + 1, dtype=np.int32) * y.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=["row", "vector"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, vector array<double>")


def _svd_of_rows(entries: DataFrame, columns: DataFrame, size: int, rank: int, rounds: int) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """The triples where thin matrices over the columns travel: a round is one pass over the rows, which stay where they are."""
    spark = entries.sparkSession
    k = columns.select(F.size("vector")).first()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    told = entries.join(sized(columns.select("col", "at"), size), "col").select("row", "at", F.col("value").cast("double").alias("value"))
    # A row has as many entries as there are columns at most; both sums use one shuffle.
    summed = told.repartition(parts, "row").groupBy("row", "at").agg(F.sum("value").alias("value")).where("value <> 0")
    listed = summed.groupBy("row").agg(F.collect_list(F.struct("at", "value")).alias("e")).select("row", "e.at", "e.value")
    rows = materialize(listed, "rows")
    none = rows.select("row", F.array().cast("array<double>").alias("vector")).limit(0), np.zeros(0), columns.select("col", F.array().cast("array<double>").alias("vector")).limit(0)
    if k is None:
        return none
    first = columns.select("at", "vector").toArrow()
    right = np.zeros((size, k[0]))
    right[first.column("at").to_numpy()] = first.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k[0])
    for left_rounds in range(rounds, -1, -1):
        square, seen, met = _passed(rows, np.ascontiguousarray(right.T))
        turn = _turn(square)
        if not turn.shape[1] or not met.any():
            return none
        seen = seen @ turn
        if left_rounds:
            vectors, values, _ = np.linalg.svd(seen, full_matrices=False)
            right = vectors[:, values**2 > 1e-13 * values[0] ** 2]
    whole = len(list(_groups(right.shape[1], size))) == 1
    if whole:
        left = materialize(_rows_times(rows, np.ascontiguousarray(right.T), turn), "left")
        # Once more by what was written, as rounding of the first turn shows in small directions.
        again = _turn(gram(left, turn.shape[1]))
        seen = seen @ again
    else:
        made = right @ turn
        square, seen, _ = _passed(rows, np.ascontiguousarray(made.T))
        again = _turn(square)
        seen = seen @ again
    squares, turn = np.linalg.eigh(seen.T @ seen)
    top = np.argsort(-squares)[:rank]
    top = top[squares[top] > 1e-13 * squares.max()]
    values = np.sqrt(squares[top])
    right = seen @ turn[:, top] / values
    size_of = np.where(met[:, None], np.round(np.abs(right), 9), -1.0)
    greatest = size - 1 - size_of[::-1].argmax(axis=0)
    flip = np.diag(np.where(right[greatest, np.arange(len(top))] >= 0, 1.0, -1.0))
    import pyarrow as pa

    used, right = np.flatnonzero(met).astype(np.int32), right[met] @ flip
    vectors = spark.createDataFrame(pa.table({"at": used, "vector": pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * len(top), pa.array(right.ravel()))}))
    found = columns.select("col", "at").join(sized(vectors, size), "at").select("col", "vector")
    if whole:
        return left.select("row", turned(F.col("vector"), again @ turn[:, top] @ flip).alias("vector")), values, found
    made, parts = np.ascontiguousarray((made @ (again @ turn[:, top] @ flip)).T), None
    for of in _groups(*made.shape):
        part = materialize(_rows_times(rows, made[of], np.eye(len(made[of]))), "left").withColumn("g", F.lit(of.start))
        parts = part if parts is None else parts.unionByName(part)
    listed = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("g", "vector"))).alias("l"))
    return listed.select("row", F.flatten("l.vector").alias("vector")), values, found


def truncated_svd(entries: DataFrame, rank: int, oversample: int = 8, rounds: int = 6, seed: int = 5) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(row, vector), singular values falling, (col, vector): the leading singular triples by a randomised range finder.

    Random signs for each column, drawn by hash, span a first range; every round multiplies with the matrix and its
    transpose and makes the range orthonormal again. Signs are as they come: the greatest entry of each right vector is
    positive. Fewer than `rank` triples come of a matrix of lower rank.
    """
    k = rank + oversample
    sign = lambda j: F.when(F.pmod(F.xxhash64(F.col("col"), F.lit(seed), F.lit(j)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    columns = materialize(entries.select("col").where("col is not null").distinct(), "columns")
    size = columns.count()
    if size * 8 <= THIN_BYTES:
        starts = numbered(columns, ["col"]).select("col", F.col("_at").cast("int").alias("at"), F.array(*[sign(j) for j in range(k)]).alias("vector"))
        return _svd_of_rows(entries, materialize(starts, "columns"), size, rank, rounds)
    e = materialize(entries.groupBy("row", "col").agg(F.sum(F.col("value").cast("double")).alias("value")).where("value <> 0"), "entries")
    start = e.select("col").distinct().select("col", F.array(*[sign(j) for j in range(k)]).alias("vector"))
    left, k = orthonormal(materialize(multiply(e, start, "row", "col", k), "range"), "row", k)
    for _ in range(rounds):
        if not k:
            break
        right, k = orthonormal(materialize(multiply(e, left, "col", "row", k), "range"), "col", k)
        left, k = orthonormal(materialize(multiply(e, right, "row", "col", k), "range"), "row", k)
    if not k:
        return left, np.zeros(0), e.select("col", F.array().cast("array<double>").alias("vector")).limit(0)
    # The matrix seen from the range: its columns' vectors, whose Gram matrix has the squared singular values.
    seen = materialize(multiply(e, left, "col", "row", k), "seen")
    squares, turn = np.linalg.eigh(gram(seen, k))
    top = np.argsort(-squares)[:rank]
    top = top[squares[top] > 1e-13 * squares.max()]
    values = np.sqrt(squares[top])
    right = materialize(seen.select("col", turned(F.col("vector"), turn[:, top] / values).alias("vector")), "right")
    v = F.col("vector")
    greatest = right.agg(*[F.max_by(v[j], F.struct(F.round(F.abs(v[j]), 9), F.col("col"))) for j in range(len(top))]).first()
    flip = np.diag([1.0 if (x or 0) >= 0 else -1.0 for x in greatest])
    right = right.select("col", turned(v, flip).alias("vector"))
    return left.select("row", turned(v, turn[:, top] @ flip).alias("vector")), values, right


def latent_semantic_analysis(weights: DataFrame, id_col: str, rank: int, **options) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(id, vector), singular values, (term, vector) of a table of term weights (id, term, weight), as `text.tfidf` gives."""
    left, values, right = truncated_svd(weights.select(F.col(id_col).alias("row"), F.col("term").alias("col"), F.col("weight").alias("value")), rank, **options)
    scaled = turned(F.col("vector"), np.diag(values)) if len(values) else F.col("vector")
    return left.select(F.col("row").alias(id_col), scaled.alias("vector")), values, right.select(F.col("col").alias("term"), "vector")


def nmf(entries: DataFrame, rank: int, rounds: int = 50, seed: int = 5) -> tuple[DataFrame, DataFrame, list[float]]:
    """(row, vector), (col, vector), errors: non-negative factors by multiplicative updates; the error never rises.

    The error is the norm of what the factors leave, from the entries and k x k products alone: no dense matrix is made.
    Negative entries raise an error. Starts are drawn by hash.
    """
    e = materialize(entries.groupBy("row", "col").agg(F.sum(F.col("value").cast("double")).alias("value")).where("value <> 0"), "entries")
    n, squares, total, least = e.agg(F.count("*"), F.sum(F.col("value") ** 2), F.sum("value"), F.min("value")).first()
    if n and least < 0:
        raise ValueError("the entries have to be non-negative")
    k, tiny = rank, 1e-12
    cells = max(e.select("row").distinct().count() * e.select("col").distinct().count(), 1)
    scale = ((total or 0.0) / cells / k) ** 0.5

    def start(side: str) -> DataFrame:
        draw = lambda j: F.pmod(F.xxhash64(F.col(side).cast("string"), F.lit(f"{seed}:{side}:{j}")), F.lit(1_000_003)) / 1_000_003.0 + 0.01
        return materialize(e.select(side).distinct().select(side, F.array(*[draw(j) * 2 * scale for j in range(k)]).alias("vector")), "factor")

    w, h = start("row"), start("col")

    def updated(own: DataFrame, other: DataFrame, of: str, by: str) -> tuple[DataFrame, DataFrame]:
        g = gram(other, k)
        met = multiply(e, other, of, by, k).withColumnRenamed("vector", "up")
        both = own.join(met, of)
        down = turned(F.col("vector"), g)
        step = F.array(*[F.col("vector")[j] * F.col("up")[j] / (down[j] + tiny) for j in range(k)])
        return materialize(both.select(of, step.alias("vector"), "up"), "factor"), g

    errors: list[float] = []
    for _ in range(rounds):
        h, _ = updated(h.select("col", "vector"), w.select("row", "vector"), "col", "row")
        w, g = updated(w.select("row", "vector"), h.select("col", "vector"), "row", "col")
        # |A - WH|^2 = |A|^2 - 2 <A H', W> + <W'W, HH'>, the middle from the product that the update has made.
        v = F.col("vector")
        inner = w.agg(F.sum(sum((v[j] * F.col("up")[j] for j in range(1, k)), v[0] * F.col("up")[0]))).first()[0] or 0.0
        errors.append(float(max((squares or 0.0) - 2 * inner + (gram(w, k) * g).sum(), 0.0) ** 0.5))
    return w.select("row", "vector"), h.select("col", "vector"), errors
