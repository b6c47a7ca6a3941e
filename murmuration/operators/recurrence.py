"""Linear recurrences over ordered series as prefix scans: smoothing, ARMA residuals, filters, Kalman means.

A step of such a series is an affine map of its state, s = A s + B u, and affine maps compose. Rows are range-sorted into
parts, whatever the number of series; every part folds its own maps from a zero state, batch by batch, and keeps of
itself one composed map. The parts' maps are composed in order on the driver (a vector for each part), and every row then
adds what its part was handed. So a series of any length is spread over as many tasks as it has parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize, sized
from .ordering import numbered

#: Steps within which the gains of a filter have to settle.
SETTLE = 100_000
_KEEP = ("_part", "_i", "_g", "_z", "_m")


def _power(a: np.ndarray, steps: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a^steps x for each number of steps, by the bits of the numbers."""
    out, square, left = np.tile(x, (len(steps), 1)), a, steps.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = out[odd] @ square.T
        square, left = square @ square, left >> 1
    return out


def _scan(a: np.ndarray, b: np.ndarray, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States and composed matrices of n steps s = a s + b, started anew at the places `since`; by doubling.

    a is one matrix, or one for each step; the composed matrices are only made for the second.
    """
    n, place, shift = len(b), np.arange(len(b)), 1
    z, m = b.copy(), a
    longest = int((place - since).max(initial=-1)) + 1
    while shift < longest:
        at = np.flatnonzero(place - shift >= since)
        if a.ndim == 2:
            z[at] = z[at] + z[at - shift] @ m.T
            m = m @ m
        else:
            z[at] = z[at] + np.einsum("nij,nj->ni", m[at], z[at - shift])
            nxt = m.copy()
            nxt[at] = m[at] @ m[at - shift]
            m = nxt
        shift *= 2
    return z, m


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def recurrence(
    df: DataFrame,
    order: list,
    by: list[str],
    transition: np.ndarray,
    gain: np.ndarray,
    inputs: list[Column],
    start: Column,
    kind: Column | None = None,
    out: str = "state",
) -> DataFrame:
    """Adds `out`, the state (array<double>) after each row: s = A s + B u in the order given, within `by`.

    `transition` is A (d, d) and `gain` B (d, p) for the p `inputs` u; with `kind` (an integer column) both have a leading
    axis, and each row takes the pair of its kind. `start` is the state before a series' first row, read from that row.
    Inputs have to be free of nulls. `order` has to tell the rows of a series apart for repeatable states.
    """
    a, b = np.asarray(transition, float), np.asarray(gain, float)
    d, p, varying = a.shape[-1], len(inputs), kind is not None
    keyed = df.withColumns({
        "_g": F.to_json(F.struct(*by)) if by else F.lit(""),
        "_u": F.array(*[c.cast("double") for c in inputs]),
        "_s": start.cast("array<double>"),
        "_k": kind.cast("int") if varying else F.lit(0),
        **{f"_o{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(order)},
    })
    keys = [*by, *[f"_o{i}" for i in range(len(order))]]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_parts = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(*[f"_o{i}" for i in range(len(order))])
    kept = [f for f in sorted_parts.schema if f.name not in ("_u", "_k")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _part int, _i bigint, _z array<double>, _m array<double>"

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen, held, state = TaskContext.get().partitionId(), 0, None, np.zeros(d)
        # Steps since the part began, or the composed matrix of those steps; nothing of either after a new series.
        steps, composed, open_ = 0, np.eye(d), True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = np.array(batch.column("_g").to_pylist(), dtype=object)
            k = batch.column("_k").to_numpy()
            own_a = a[k] if varying else a
            u = _matrix(batch.column("_u"), p)
            moved = np.einsum("nij,nj->ni", b[k], u) if varying else u @ b.T
            new = np.append(held is not None and g[0] != held, g[1:] != g[:-1])
            firsts = np.flatnonzero(new)
            if len(firsts):
                begin = _matrix(batch.column("_s").take(pa.array(firsts)), d)
                moved[firsts] += np.einsum("nij,nj->ni", own_a[firsts], begin) if varying else begin @ a.T
            if not new[0]:
                moved[0] += (own_a[0] if varying else a) @ state
            place = np.arange(n)
            since = np.maximum.accumulate(np.where(new, place, 0))
            z, m = _scan(own_a, moved, since)
            within = open_ & (place < (firsts[0] if len(firsts) else n))
            if varying:
                told = [row.ravel() if w else None for row, w in zip(m @ composed, within)]
                composed = m[-1] @ composed
            else:
                told = [[float(steps + i + 1)] if w else None for i, w in enumerate(within)]
            steps, open_, held, state = steps + n, open_ and not len(firsts), g[-1], z[-1]
            lists = lambda rows: pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n)), lists(list(z)), lists(told)],
                names=[*(f.name for f in kept), "_part", "_i", "_z", "_m"],
            )
            seen += n

    folded = materialize(sorted_parts.mapInArrow(fold, schema), "scan")
    ends = folded.groupBy("_part").agg(
        F.min_by(F.struct("_g", "_s"), "_i").alias("first"), F.max_by(F.struct("_g", "_z", "_m"), "_i").alias("last")
    )
    handed: dict[int, np.ndarray] = {}
    before, state = None, None
    for r in ends.orderBy("_part").collect():
        handed[r._part] = state if r.first["_g"] == before else np.array(r.first["_s"])
        m, z = r.last["_m"], np.array(r.last["_z"])
        if m is None:
            state = z
        elif varying:
            state = np.array(m).reshape(d, d) @ handed[r._part] + z
        else:
            state = _power(a, np.array([int(m[0])]), handed[r._part])[0] + z
        before = r.last["_g"]

    rest = [f for f in folded.schema if f.name not in (*_KEEP, "_s")]

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            z = _matrix(batch.column("_z"), d).copy()
            part, m = batch.column("_part").to_numpy(), batch.column("_m")
            at = np.flatnonzero(m.is_valid().to_numpy(zero_copy_only=False))
            told = _matrix(m.take(pa.array(at)), d * d if varying else 1)
            for x in np.unique(part[at]):
                mine = part[at] == x
                if varying:
                    z[at[mine]] += told[mine].reshape(-1, d, d) @ handed[x]
                else:
                    z[at[mine]] += _power(a, told[mine, 0].astype(np.int64), handed[x])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(list(z), pa.list_(pa.float64()))], names=[*(f.name for f in rest), out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return folded.mapInArrow(apply, f"{schema}, `{out}` array<double>")


def with_groups(df: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """The rows with the columns of their series; starts: a row for each series. Null keys are series, too."""
    if not by:
        return df.crossJoin(F.broadcast(starts))
    named = starts.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], *[c for c in starts.columns if c not in by])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return df.join(sized(named), same).drop(*[f"_b{i}" for i in range(len(by))])


def _first_values(df: DataFrame, value: str, order: list, by: list[str], count: int) -> DataFrame:
    """(by..., _x): the first `count` values of each series, in order."""
    if count == 1:
        key = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
        return df.groupBy(*by).agg(F.array(F.min_by(F.col(value).cast("double"), key)).alias("_x"))
    early = numbered(df.select(*by, value, *order), order, by).where(F.col("_at") < count)
    listed = F.sort_array(F.collect_list(F.struct("_at", F.col(value).cast("double").alias("v"))))
    return early.groupBy(*by).agg(F.transform(listed, lambda e: e["v"]).alias("_x"))


def _known(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def simple_smoothing(df: DataFrame, value: str, order: list, by: list[str], alpha: float = 0.3) -> DataFrame:
    """Adds fitted (the level before a row) and level, by simple exponential smoothing from each series' first value.

    Rows without a value are left out.
    """
    rows = _known(df, value)
    rows = with_groups(rows, _first_values(rows, value, order, by, 1), by)
    keep = 1.0 - alpha
    found = recurrence(rows, order, by, [[keep, 0], [1, 0]], [[alpha], [0]], [F.col(value)], F.concat("_x", F.array(F.lit(0.0))), out="_state")
    return found.withColumns({"level": F.col("_state")[0], "fitted": F.col("_state")[1]}).drop("_state", "_x")


def holt(df: DataFrame, value: str, order: list, by: list[str], alpha: float = 0.3, beta: float = 0.1, phi: float = 1.0) -> DataFrame:
    """Adds fitted, level and trend, by linear exponential smoothing; phi below 1 damps the trend.

    A series starts at its first value with the first difference as trend (none where it has one value). Rows without a
    value are left out.
    """
    rows = _known(df, value)
    starts = _first_values(rows, value, order, by, 2)
    x = F.col("_x")
    begin = F.array(x[0], F.when(F.size(x) > 1, F.try_element_at(x, F.lit(2)) - x[0]).otherwise(0.0), F.lit(0.0))
    rows = with_groups(rows, starts.select(*by, begin.alias("_x")), by)
    ahead = np.array([1.0, phi, 0.0])  # level plus damped trend
    level = (1 - alpha) * ahead
    trend = beta * (level - [1, 0, 0]) + [0, (1 - beta) * phi, 0]
    found = recurrence(rows, order, by, np.array([level, trend, ahead]), [[alpha], [alpha * beta], [0]], [F.col(value)], x, out="_state")
    return found.withColumns({c: F.col("_state")[i] for i, c in enumerate(("level", "trend", "fitted"))}).drop("_state", "_x")


def holt_winters(
    df: DataFrame, value: str, order: list, by: list[str], season: int = 12, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, trend: bool = True
) -> DataFrame:
    """Adds fitted, level, trend and seasonal (the season's term as this row leaves it), by additive triple smoothing.

    A series starts from its first two seasons: their means give level and trend, the first one's departures from its
    mean the seasons. Series of less than two seasons are left out, as are rows without a value. (The multiplicative
    form divides by its own state, so it is no linear recurrence: take logarithms.)
    """
    rows, m = _known(df, value), season
    x = F.col("_x")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / m
    first, second = mean(F.slice(x, 1, m)), mean(F.slice(x, m + 1, m))
    slope = (second - first) / m if trend else F.lit(0.0)
    begin = F.concat(F.array(first, slope, F.lit(0.0)), F.transform(F.slice(x, 1, m), lambda v: v - first))
    starts = _first_values(rows, value, order, by, 2 * m).where(F.size(x) == 2 * m).select(*by, begin.alias("_x"))
    # level, trend, fitted, then the seasons' terms: the next row's first, the one just left last.
    d = m + 3
    ahead, old = np.zeros(d), np.zeros(d)
    ahead[:2] = 1
    old[3] = 1
    a, b = np.zeros((d, d)), np.zeros((d, 1))
    a[0], b[0] = (1 - alpha) * ahead - alpha * old, alpha
    if trend:
        a[1], b[1] = beta * a[0], beta * alpha
        a[1, 0] -= beta
        a[1, 1] += 1 - beta
    a[2] = ahead + old
    a[np.arange(3, d - 1), np.arange(4, d)] = 1
    a[d - 1], b[d - 1] = (1 - gamma) * old - gamma * a[0], gamma * (1 - alpha)
    found = recurrence(with_groups(rows, starts, by), order, by, a, b, [F.col(value)], x, out="_state")
    return found.withColumns({"level": F.col("_state")[0], "trend": F.col("_state")[1], "fitted": F.col("_state")[2], "seasonal": F.col("_state")[d - 1], "seasons": F.slice("_state", 4, m)}).drop("_state", "_x")


def forecast(smoothed: DataFrame, order: list, by: list[str], steps: int, phi: float = 1.0) -> DataFrame:
    """(by..., step, forecast) for 1 to `steps` rows after each series' end, from the last states of the functions above."""
    key = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
    states = [c for c in ("level", "trend", "seasons") if c in smoothed.columns]
    last = smoothed.groupBy(*by).agg(F.max_by(F.struct(*states), key).alias("s"))
    far = last.select(*by, "s", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    found = F.col("s.level")
    if "trend" in states:
        factor = F.col("step").cast("double") if phi == 1 else F.lit(phi) * (1 - F.pow(F.lit(phi), F.col("step"))) / (1 - phi)
        found = found + factor * F.col("s.trend")
    if "seasons" in states:
        found = found + F.element_at("s.seasons", ((F.col("step") - 1) % F.size("s.seasons") + 1).cast("int"))
    return far.select(*by, F.col("step").cast("long").alias("step"), found.alias("forecast"))


def lags(df: DataFrame, value: str, order: list, by: list[str], count: int) -> DataFrame:
    """Adds lags: the `count` values before a row, the last first; zeros where a series has none, `_at` its place."""
    rows = numbered(_known(df, value), order, by).drop("_n")
    d = count + 1
    a = np.eye(d, k=-1)
    found = recurrence(rows, order, by, a, np.eye(d)[:, :1], [F.col(value)], F.array(*[F.lit(0.0)] * d), out="_state")
    return found.withColumn("lags", F.slice("_state", 2, count)).drop("_state")


def autoregression(df: DataFrame, value: str, order: list, by: list[str], p: int = 1) -> DataFrame:
    """(by..., mean, coefficients, sigma2, n): least squares of each centred value on the p before it.

    Sums of products are aggregated by series; series whose lags are collinear get the solution of least norm.
    """
    centre = _known(df, value).groupBy(*by).agg(F.avg(value).alias("_mean"))
    rows = with_groups(_known(df, value), centre, by).withColumn("_c", F.col(value).cast("double") - F.col("_mean"))
    used = lags(rows, "_c", order, by, p).where(F.col("_at") >= p)
    terms = [F.col("lags")[i] for i in range(p)] + [F.col("_c")]
    sums = used.groupBy(*by, F.col("_mean").alias("mean")).agg(
        F.count("*").alias("n"), F.array(*[F.sum(terms[i] * terms[j]) for i in range(p + 1) for j in range(p + 1)]).alias("xx"), F.avg(terms[-1]).alias("y"), F.array(*[F.avg(t) for t in terms[:p]]).alias("x")
    )

    def solve(batches: Iterator) -> Iterator:
        for pdf in batches:
            xx = np.stack(pdf.pop("xx").to_numpy()).reshape(-1, p + 1, p + 1) if len(pdf) else np.zeros((0, p + 1, p + 1))
            w = np.array([np.linalg.lstsq(m[:p, :p], m[:p, p], rcond=1e-12)[0] for m in xx]).reshape(-1, p)
            squares = np.array([m[p, p] - 2 * v @ m[:p, p] + v @ m[:p, :p] @ v for m, v in zip(xx, w)])
            off = pdf["y"].to_numpy() - np.array([v @ np.asarray(x) for v, x in zip(w, pdf["x"])])
            yield pdf.drop(columns=["x", "y"]).assign(coefficients=list(w), sigma2=np.maximum(squares / pdf["n"].to_numpy() - off**2, 0.0))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in (*by, "mean", "n"))
    return sums.mapInPandas(solve, f"{schema}, coefficients array<double>, sigma2 double").select(*by, "mean", "coefficients", "sigma2", "n")


def arma_residuals(df: DataFrame, value: str, order: list, by: list[str], ar: list[float], ma: list[float]) -> DataFrame:
    """Adds resid: what an ARMA model with these coefficients leaves of a centred value; nothing precedes a series."""
    p, q = len(ar), len(ma)
    d = max(q, 1) + p
    a, b = np.zeros((d, d)), np.zeros((d, 1))
    # The last errors, then the last values.
    a[0, :q], a[0, d - p :], b[0] = -np.array(ma), -np.array(ar), 1
    a[np.arange(1, max(q, 1)), np.arange(max(q, 1) - 1)] = 1
    if p:
        b[d - p] = 1
        a[np.arange(d - p + 1, d), np.arange(d - p, d - 1)] = 1
    found = recurrence(_known(df, value), order, by, a, b, [F.col(value)], F.array(*[F.lit(0.0)] * d), out="_state")
    return found.withColumn("resid", F.col("_state")[0]).drop("_state")


def kalman_gains(f, h, q, r, p0, settle: int = SETTLE) -> tuple[np.ndarray, np.ndarray]:
    """Gains and filtered covariances of steps 1, 2, ... of a linear Gaussian model, up to where they no longer change.

    They do not depend on what is observed. A model whose gains do not settle (no process noise) raises an error.
    """
    f, h, q, r, p = (np.atleast_2d(np.asarray(x, float)) for x in (f, h, q, r, p0))
    gains, covariances = [], []
    for _ in range(settle):
        p = f @ p @ f.T + q
        k = np.linalg.solve((h @ p @ h.T + r).T, (p @ h.T).T).T
        p = (np.eye(len(f)) - k @ h) @ p
        gains.append(k)
        covariances.append(p)
        if len(gains) > 1 and np.allclose(gains[-1], gains[-2], rtol=1e-15, atol=0) and np.allclose(covariances[-1], covariances[-2], rtol=1e-15, atol=0):
            return np.array(gains), np.array(covariances)
    raise ValueError(f"the gains do not settle within {settle} steps")


def kalman_filter(df: DataFrame, values: list[str], order: list, by: list[str], f, h, q, r, x0=None, p0=None) -> DataFrame:
    """Adds mean (array: the filtered state) and covariance (array, by rows) of x = F x + noise, values = H x + noise.

    `x0` and `p0` (zeros and the identity if not given) are the state before a series' first row. Rows that lack one of
    the values are left out.
    """
    f, h = np.atleast_2d(np.asarray(f, float)), np.atleast_2d(np.asarray(h, float))
    d = len(f)
    gains, covariances = kalman_gains(f, h, q, r, np.eye(d) if p0 is None else p0)
    rows = df
    for v in values:
        rows = _known(rows, v)
    rows = numbered(rows, order, by).drop("_n").withColumn("_k", F.least("_at", F.lit(len(gains) - 1)).cast("int"))
    keep = np.array([(np.eye(d) - k @ h) @ f for k in gains])
    start = F.array(*[F.lit(float(v)) for v in (np.zeros(d) if x0 is None else np.asarray(x0, float))])
    found = recurrence(rows.withColumnRenamed("_k", "_kind"), order, by, keep, gains, [F.col(v) for v in values], start, F.col("_kind"), "mean")
    spread = found.sparkSession.createDataFrame([(i, [float(v) for v in c.ravel()]) for i, c in enumerate(covariances)], "_kind int, covariance array<double>")
    return found.join(sized(spread, len(gains)), "_kind").drop("_kind", "_at")


def local_level(df: DataFrame, value: str, order: list, by: list[str], walk: float = 1.0, noise: float = 10.0) -> DataFrame:
    """Adds level: the filtered level of a random walk seen through noise; a series starts at its first value."""
    rows = _known(df, value)
    rows = with_groups(rows, _first_values(rows, value, order, by, 1), by)
    gains, _ = kalman_gains(1.0, 1.0, walk, noise, noise)
    k = np.append(0.0, gains.ravel())
    placed = numbered(rows, order, by).withColumn("_kind", F.least("_at", F.lit(len(k) - 1)).cast("int")).drop("_at", "_n")
    found = recurrence(placed, order, by, (1 - k)[:, None, None], k[:, None, None], [F.col(value)], F.col("_x"), F.col("_kind"), "_state")
    return found.withColumn("level", F.col("_state")[0]).drop("_state", "_x", "_kind")


def adaptive_coverage(df: DataFrame, missed: str, order: list, by: list[str], wanted: float = 0.1, rate: float = 0.05) -> DataFrame:
    """Adds alpha: the level at which intervals are to be made after each row so that misses keep the wanted share."""
    miss = F.when(F.col(missed).cast("double") != 0, 1.0).otherwise(0.0)
    found = recurrence(_known(df, missed), order, by, [[1.0]], [[rate]], [wanted - miss], F.array(F.lit(float(wanted))), out="_state")
    return found.withColumn("alpha", F.col("_state")[0]).drop("_state")
