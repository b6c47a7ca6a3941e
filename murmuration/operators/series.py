"""Time series, signals, survival curves and change points, as windows over (series, time, value) rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize
from .ordering import numbered, running
from .recurrence import with_groups


def difference(df: DataFrame, value: str, order: list, by: list[str], d: int = 1, out: str = "diff") -> DataFrame:
    """The d-th difference; rows without enough past have none."""
    w = Window.partitionBy(*by).orderBy(*order)
    current = df.withColumn(out, F.col(value).cast("double"))
    for _ in range(d):
        current = current.withColumn(out, F.col(out) - F.lag(out).over(w))
    return current


def integrate(df: DataFrame, value: str, order: list, by: list[str], start: float = 0.0, out: str = "level") -> DataFrame:
    """Running sum of differences from a start value."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w) + start)


def fourier_features(t: Column, period: float, n_harmonics: int = 3) -> dict[str, Column]:
    return {
        f"{name}{h}": f(2 * math.pi * h * t / period)
        for h in range(1, n_harmonics + 1)
        for name, f in (("sin", F.sin), ("cos", F.cos))
    }


def moving_average(df: DataFrame, value: str, order: list, by: list[str], m: int, out: str = "trend") -> DataFrame:
    """Centred mean of m values (the two ends weigh half where m is even); null at the edges."""
    w = Window.partitionBy(*by).orderBy(*order)
    h = m // 2
    if m % 2:
        window = w.rowsBetween(-h, h)
        full = F.count(value).over(window) == m
        return df.withColumn(out, F.when(full, F.avg(value).over(window)))
    inner, outer = w.rowsBetween(-h + 1, h - 1), w.rowsBetween(-h, h)
    ends = F.lag(value, h).over(w) + F.lead(value, h).over(w)
    return df.withColumn(out, F.when(F.count(value).over(outer) == m + 1, (F.sum(value).over(inner) + ends / 2) / m))


def seasonal_decompose(df: DataFrame, value: str, order: list, by: list[str], m: int = 12, model: str = "additive") -> DataFrame:
    """Adds trend, seasonal and resid: a centred moving average and the mean of what is left per season."""
    add = model == "additive"
    t = moving_average(df, value, order, by, m).withColumn("_k", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % m)
    t = t.withColumn("_d", F.col(value) - F.col("trend") if add else F.col(value) / F.col("trend"))
    raw = t.groupBy(*by, "_k").agg(F.avg("_d").alias("_s"))
    every = Window.partitionBy(*by)
    seasonal = raw.select(*by, "_k", (F.col("_s") - F.avg("_s").over(every) if add else F.col("_s") / F.avg("_s").over(every)).alias("seasonal"))
    joined = t.join(seasonal, [*by, "_k"])
    resid = F.col(value) - F.col("trend") - F.col("seasonal") if add else F.col(value) / (F.col("trend") * F.col("seasonal"))
    return joined.withColumn("resid", resid).drop("_k", "_d")


def rolling(df: DataFrame, value: str, order: list, by: list[str], w: int) -> DataFrame:
    """Mean and population deviation over the last w rows and this one."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(-w, 0)
    return df.withColumns({"mean": F.avg(value).over(window), "std": F.stddev_pop(value).over(window)})


def exponential_smoothing(df: DataFrame, value: str, order: list, by: list[str], alpha: float = 0.3) -> DataFrame:
    """(by..., level): the last level of simple exponential smoothing, as a weighted sum over each series.

    A value k places before the end weighs alpha * (1 - alpha) ** k, the first one (1 - alpha) ** k; nothing is gathered.
    """
    placed = numbered(df.where(F.col(value).isNotNull()), order, by)
    late = F.pow(F.lit(1.0 - alpha), F.col("_n") - 1 - F.col("_at"))
    weight = F.when(F.col("_at") == 0, late).otherwise(alpha * late)
    return placed.groupBy(*by).agg(F.sum(F.col(value).cast("double") * weight).alias("level"))


def autocorrelation(df: DataFrame, value: str, order: list, by: list[str], lags: int = 10) -> DataFrame:
    """(by..., lag, acf, n)."""
    centred = df.withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    w = Window.partitionBy(*by).orderBy(*order)
    pairs = centred.withColumns({f"_l{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    sums = pairs.groupBy(*by).agg(F.sum(F.col("_c") ** 2).alias("_v"), F.count("*").alias("n"), *[F.sum(f"_l{k}").alias(f"_s{k}") for k in range(1, lags + 1)])
    each = F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(F.col(f"_s{k}") / F.col("_v"), F.lit(0.0)).alias("acf")) for k in range(1, lags + 1)])
    return sums.select(*by, "n", F.explode(each).alias("e")).select(*by, "n", "e.lag", "e.acf")


def ljung_box(df: DataFrame, value: str, order: list, by: list[str], lags: int = 10) -> DataFrame:
    """(by..., q): n (n + 2) * sum of acf^2 / (n - k)."""
    a = autocorrelation(df, value, order, by, lags)
    return a.groupBy(*by).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag")))).alias("q"))


def durbin_watson(df: DataFrame, value: str, order: list, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    return d.groupBy(*by).agg((F.sum(F.col("_d") ** 2) / F.sum(F.col(value) ** 2)).alias("dw"))


def jarque_bera(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    s, k = F.skewness(value), F.kurtosis(value)
    return df.groupBy(*by).agg((F.count(value) / 6 * (s * s + k * k / 4)).alias("jb"))


def cusum(df: DataFrame, value: str, order: list, by: list[str], drift: float = 0.0) -> DataFrame:
    """(by..., at, peak, change): the place of the largest cumulative deviation, and whether it passes 4 sd sqrt(n)."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    centred = with_groups(df, stats, by).withColumns({"_d": F.col(value) - F.col("_mean") - drift, "_one": F.lit(1).cast("long")})
    c = running(centred, order, {"_s": "_d", "_i": "_one"}, by)
    g = c.groupBy(*by).agg(F.max(F.abs("_s")).alias("peak"), F.first("_sd").alias("_sd"), F.count("*").alias("_n"), (F.max_by("_i", F.abs("_s")) - 1).alias("at"))
    return g.select(*by, "at", "peak", (F.col("peak") > 4 * F.col("_sd") * F.sqrt("_n")).alias("change"))


def peaks(df: DataFrame, value: str, order: list, by: list[str], height: float | None = None) -> DataFrame:
    """Rows above both neighbours (and a height)."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)})
    found = marked.where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")))
    return (found if height is None else found.where(F.col(value) >= height)).drop("_a", "_b")


def zero_crossing_rate(df: DataFrame, value: str, order: list, by: list[str], frame: int = 256) -> DataFrame:
    """(by..., frame, rate): sign changes per step inside frames of rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    f = df.withColumn("frame", F.floor((F.row_number().over(w) - 1) / frame).cast("int"))
    inside = Window.partitionBy(*by, "frame").orderBy(*order)
    sign = F.col(value) >= 0
    f = f.withColumn("_x", (sign != F.lag(sign).over(inside)).cast("int"))
    return f.groupBy(*by, "frame").agg((F.coalesce(F.sum("_x"), F.lit(0)) / F.greatest(F.count("*") - 1, F.lit(1))).alias("rate"))


# Survival: rows are (group, duration, event).


def life_table(df: DataFrame, duration: str, event: str, by: list[str]) -> DataFrame:
    """(by..., time, d, c, n): events, all exits and the number at risk at every distinct time."""
    g = df.groupBy(*by, F.col(duration).alias("time")).agg(F.sum(F.col(event).cast("long")).alias("d"), F.count("*").alias("c"))
    gone = running(g, ["time"], {"_upto": "c"}, by, totals=True)
    return gone.withColumn("n", F.col("_upto_all") - F.col("_upto") + F.col("c")).drop("_upto", "_upto_all")


def kaplan_meier(df: DataFrame, duration: str, event: str, by: list[str]) -> DataFrame:
    """(by..., time, d, n, survival, variance): the product of 1 - d/n and Greenwood's variance."""
    t = life_table(df, duration, event, by).where("d > 0").drop("c")
    left, all_gone = F.col("n") - F.col("d"), F.col("d") == F.col("n")
    terms = t.withColumns({
        "_log": F.when(~all_gone, F.ln(left / F.col("n"))).otherwise(0.0), "_over": all_gone.cast("long"),
        "_var": F.when(~all_gone, F.col("d") / (F.col("n") * left)).otherwise(0.0),
    })
    sums = running(terms, ["time"], {"_logs": "_log", "_ended": "_over", "_vars": "_var"}, by)
    s = F.when(F.col("_ended") > 0, 0.0).otherwise(F.exp("_logs"))
    return sums.select(*by, "time", "d", "n", s.alias("survival"), (s * s * F.col("_vars")).alias("variance"))


def nelson_aalen(df: DataFrame, duration: str, event: str, by: list[str]) -> DataFrame:
    t = life_table(df, duration, event, by).where("d > 0").withColumn("_h", F.col("d") / F.col("n"))
    return running(t, ["time"], {"hazard": "_h"}, by).select(*by, "time", "hazard")


def aalen_johansen(df: DataFrame, duration: str, cause: str, of: int) -> DataFrame:
    """(time, cif): cumulative incidence of one cause (0 is censored) against all others."""
    g = df.groupBy(F.col(duration).alias("time")).agg(F.sum((F.col(cause) != 0).cast("long")).alias("d"), F.sum((F.col(cause) == of).cast("long")).alias("k"), F.count("*").alias("c"))
    t = running(g, [-F.col("time")], {"n": "c"}).where("d > 0")
    step = F.when(F.col("d") < F.col("n"), F.ln(1 - F.col("d") / F.col("n"))).otherwise(0.0)
    t = t.withColumns({"_l": step, "_e": (F.col("d") == F.col("n")).cast("int")})
    t = running(t, ["time"], {"_u": "_l", "_gone": "_e"})
    # Survival just before a time: the running sums without the time's own step.
    left = F.when(F.col("_gone") > F.col("_e"), 0.0).otherwise(F.exp(F.col("_u") - F.col("_l")))
    t = t.withColumn("_h", left * F.col("k") / F.col("n"))
    return running(t.select("time", "_h"), ["time"], {"cif": "_h"}).drop("_h")


def log_rank(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """chi2 of the log-rank test between two groups (values 0 and 1), from one life table."""
    g = df.groupBy(F.col(duration).alias("time")).agg(
        F.sum(F.col(event).cast("long")).alias("d"), F.count("*").alias("c"),
        F.sum(F.col(event).cast("long") * F.col(group)).alias("d1"), F.sum(F.col(group).cast("long")).alias("c1"),
    )
    t = running(g, [-F.col("time")], {"n": "c", "n1": "c1"}).where("d > 0")
    e = F.col("d") * F.col("n1") / F.col("n")
    v = F.when(F.col("n") > 1, e * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    return t.agg((F.pow(F.sum("d1") - F.sum(e), 2) / F.sum(v)).alias("chi2"))


def concordance(df: DataFrame, duration: str, event: str, risk: str) -> DataFrame:
    """Share of comparable pairs that the risk orders rightly, ties one half; 0.5 if no pair compares.

    Rows are counted per distinct (time, event, risk). Both columns are replaced by dense places in their order, and the
    pairs are counted like inversions: by halving. At each level of the bits of the time's place, all pairs of an earlier
    row with an event and a later row fall into exactly one block whose halves hold the two; inside a block a running sum
    in order of risk counts them. That is one ordered pass per bit, with no join of rows with rows.
    """
    g = df.groupBy(F.col(duration).alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).alias("r")).agg(F.count("*").alias("n"))
    times = numbered(g.select("t").distinct(), ["t"]).select(F.col("t").alias("_t"), F.col("_at").cast("long").alias("p"))
    g = materialize(g.join(times, F.col("t") == F.col("_t")).select("p", "e", "r", "n"), "pairs")
    bits = int(g.agg(F.max("p")).first()[0] or 0).bit_length()
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(0, bits - 1))))
    cells = g.withColumn("b", levels).select(
        F.col("b"), F.expr("shiftright(p, b + 1)").alias("block"), "r",
        F.when(F.expr("shiftright(p, b) & 1 = 0 AND e = 1"), F.col("n")).otherwise(0).alias("early"),
        F.when(F.expr("shiftright(p, b) & 1 = 1"), F.col("n")).otherwise(0).alias("late"),
    ).groupBy("b", "block", "r").agg(F.sum("early").alias("early"), F.sum("late").alias("late"))
    met = running(cells, ["r"], {"below": "late"}, ["b", "block"], totals=True)
    good = F.sum(F.col("early") * (F.col("below") - F.col("late") / 2))
    return met.agg(F.coalesce(F.try_divide(good, F.sum(F.col("early") * F.col("below_all"))), F.lit(0.5)).alias("concordance"))


def cox(df: DataFrame, duration: str, event: str, columns: list[str], rounds: int = 6) -> DataFrame:
    """(term, coefficient): proportional hazards by Newton rounds on the partial likelihood (Breslow ties).

    Rows are summed per time; sums over those at risk are running sums from the last time on. A round is one ordered
    pass, and d x d numbers come to the driver.
    """
    beta = np.zeros(len(columns))
    d = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    for _ in range(rounds):
        e = F.exp(sum((v * float(b) for v, b in zip(x, beta)), F.lit(0.0)))
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        per = df.groupBy(F.col(duration).alias("t")).agg(
            F.sum(F.col(event).cast("double")).alias("k"), *[F.sum(F.col(event) * v).alias(f"x{i}") for i, v in enumerate(x)],
            F.sum(e).alias("e"), *[F.sum(e * v).alias(f"e{i}") for i, v in enumerate(x)], *[F.sum(e * x[i] * x[j]).alias(f"e{i}_{j}") for i, j in pairs],
        )
        sums = {"r": "e", **{f"r{i}": f"e{i}" for i in range(d)}, **{f"r{i}_{j}": f"e{i}_{j}" for i, j in pairs}}
        risk = running(per, [-F.col("t")], sums).where("k > 0")
        row = risk.agg(
            *[F.sum(F.col(f"x{i}") - F.col("k") * F.col(f"r{i}") / F.col("r")).alias(f"g{i}") for i in range(d)],
            *[F.sum(F.col("k") * (F.col(f"r{i}_{j}") / F.col("r") - F.col(f"r{i}") * F.col(f"r{j}") / F.col("r") ** 2)).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        g = np.array([row[f"g{i}"] for i in range(d)])
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return df.sparkSession.createDataFrame([(c, float(b)) for c, b in zip(columns, beta)], "term string, coefficient double")
