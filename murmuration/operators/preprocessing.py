"""Scalers, encoders of categories, bins and polynomial features.

`fit_*` functions make one pass of aggregates and return a small model with `transform(df)`; the model's parameters are
literals in the plan, so transforming is a projection without a shuffle. Category tables that can grow with the data
stay tables and are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import sized
from .columns import clean, or_one
from .ordering import numbered, percentiles, running


@dataclass(frozen=True)
class Affine:
    """x -> (x - shift) / scale, then * gain + offset, per column."""

    shift: dict[str, float]
    scale: dict[str, float]
    gain: float = 1.0
    offset: float = 0.0

    def column(self, c: str) -> Column:
        return (F.col(c) - self.shift[c]) / self.scale[c] * self.gain + self.offset

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.shift})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.offset) / self.gain * self.scale[c] + self.shift[c] for c in self.shift})


def _stats(df: DataFrame, columns: list[str], **aggregates: Callable[[Column], Column]) -> dict[str, dict]:
    row = df.agg(*[f(clean(c)).alias(f"{name}__{c}") for c in columns for name, f in aggregates.items()]).first()
    return {name: {c: row[f"{name}__{c}"] for c in columns} for name in aggregates}


def fit_standard(df: DataFrame, columns: list[str], with_mean: bool = True, with_std: bool = True) -> Affine:
    """Mean and population standard deviation; a constant column is only shifted."""
    s = _stats(df, columns, m=F.avg, d=F.stddev_pop)
    return Affine(s["m"] if with_mean else dict.fromkeys(columns, 0.0), {c: (s["d"][c] or 1.0) if with_std else 1.0 for c in columns})


def fit_min_max(df: DataFrame, columns: list[str], feature_range=(0.0, 1.0)) -> Affine:
    s = _stats(df, columns, low=F.min, high=F.max)
    low, high = feature_range
    return Affine(s["low"], {c: (s["high"][c] - s["low"][c]) or 1.0 for c in columns}, high - low, low)


def fit_max_abs(df: DataFrame, columns: list[str]) -> Affine:
    s = _stats(df, columns, top=lambda c: F.max(F.abs(c)))
    return Affine(dict.fromkeys(columns, 0.0), {c: s["top"][c] or 1.0 for c in columns})


def fit_robust(df: DataFrame, columns: list[str], quantile_range=(25.0, 75.0)) -> Affine:
    """Median and the range between two exact percentiles."""
    low, high = (q / 100 for q in quantile_range)
    q = percentiles(df, {c: clean(c) for c in columns}, [low, 0.5, high])
    return Affine({c: q[c][1] for c in columns}, {c: (q[c][2] - q[c][0]) or 1.0 for c in columns})


def normalize(df: DataFrame, columns: list[str], norm: str = "l2") -> DataFrame:
    """Each row divided by its own norm; a zero row stays."""
    values = [F.col(c) for c in columns]
    size = {
        "l2": F.sqrt(sum((v * v for v in values), F.lit(0.0))),
        "l1": sum((F.abs(v) for v in values), F.lit(0.0)),
        "max": F.greatest(F.lit(0.0), *[F.abs(v) for v in values]),
    }[norm]
    return df.withColumns({c: F.col(c) / or_one(size) for c in columns})


def binarize(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    return df.withColumns({c: (F.col(c) > threshold).cast("double") for c in columns})


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False, bias: bool = True) -> DataFrame:
    """All products of up to `degree` columns, by degree and column order."""
    pick = combinations if interaction_only else combinations_with_replacement
    out = [F.lit(1.0).alias("1")] if bias else []
    for d in range(1, degree + 1):
        for chosen in pick(columns, d):
            product = F.col(chosen[0]).cast("double")
            for c in chosen[1:]:
                product = product * F.col(c)
            out.append(product.alias("*".join(chosen)))
    return df.select("*", *out)


def bin_edges(df: DataFrame, column: str, n_bins: int = 5, strategy: str = "quantile") -> list[float]:
    """The distinct edges of quantile or uniform bins."""
    if strategy == "quantile":
        found = [v for v in percentiles(df, {column: clean(column)}, [i / n_bins for i in range(n_bins + 1)])[column] if v is not None]
    else:
        low, high = df.agg(F.min(clean(column)), F.max(clean(column))).first()
        found = [] if low is None else [low + (high - low) * i / n_bins for i in range(n_bins + 1)]
    return sorted(set(found))


def bin_index(value: Column, edges: list[float]) -> Column:
    """The bin of a value: edges open to the right, ends clipped into the first and last bin."""
    inner = edges[1:-1]
    code = sum(((value >= e).cast("int") for e in inner), F.lit(0))
    return F.when(value.isNull(), None).otherwise(code)


def discretize(df: DataFrame, column: str, n_bins: int = 5, strategy: str = "quantile", out: str = "bin") -> DataFrame:
    return df.withColumn(out, bin_index(clean(column), bin_edges(df, column, n_bins, strategy)))


def quantile_transform(df: DataFrame, column: str, n_quantiles: int = 100, out: str = "q") -> DataFrame:
    """Position between the column's percentiles, by linear interpolation, in 0..1."""
    n = n_quantiles
    q = percentiles(df, {column: clean(column)}, [i / (n - 1) for i in range(n)])[column]
    x = clean(column)
    landmarks = F.array(*[F.lit(float(v)) for v in q])
    below = F.size(F.filter(landmarks, lambda v: v <= x))
    low, high = F.element_at(landmarks, below), F.element_at(landmarks, below + 1)
    inside = (below - 1 + (x - low) / or_one(high - low)) / (n - 1)
    return df.withColumn(out, F.when(x.isNull(), None).when(x <= q[0], 0.0).when(x >= q[-1], 1.0).otherwise(inside))


def categories(df: DataFrame, column: str) -> DataFrame:
    """(category, code): the distinct values in order, numbered from 0. Null is no category."""
    distinct = df.where(F.col(column).isNotNull()).select(F.col(column).alias("category")).distinct()
    return numbered(distinct, ["category"]).select("category", F.col("_at").cast("int").alias("code"))


def ordinal_encode(df: DataFrame, column: str, table: DataFrame | None = None, out: str = "code") -> DataFrame:
    """The sorted position of each category; an unseen one gets the position at which it would stand.

    Unseen values are made distinct and placed in one order with the categories; nothing comes to the driver.
    """
    if table is None:
        known = sized(categories(df, column).withColumnRenamed("code", out))
        return df.join(known, F.col(column) == F.col("category"), "left").drop("category")
    unseen = df.select(F.col(column).alias("category")).where("category is not null").distinct().join(table.select("category"), "category", "left_anti")
    both = table.select("category", F.lit(1).alias("_k")).unionByName(unseen.withColumn("_k", F.lit(0)))
    placed = running(both, ["category"], {"_u": "_k"}).select("category", (F.col("_u") - F.col("_k")).cast("int").alias(out))
    return df.join(sized(placed), F.col(column) == F.col("category"), "left").drop("category")


def label_encode(df: DataFrame, column: str, table: DataFrame | None = None, out: str = "code") -> DataFrame:
    """The sorted position of each label; an unseen label is an error."""
    table = categories(df, column) if table is None else table
    joined = df.join(sized(table.withColumnRenamed("code", "_code")), F.col(column) == F.col("category"), "left")
    unseen = F.raise_error(F.concat(F.lit("unseen label "), F.col(column).cast("string"))).cast("int")
    return joined.withColumn(out, F.when(F.col(column).isNull(), None).otherwise(F.coalesce("_code", unseen))).drop("category", "_code")


#: Categories that can become columns.
MOST_COLUMNS = 10_000


def _few(df: DataFrame, column: str) -> list:
    """The categories in order, where they are to become columns."""
    found = [r.category for r in df.select(F.col(column).alias("category")).where("category is not null").distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} categories, too many for columns")
    return sorted(found)


def one_hot(df: DataFrame, column: str, values: list | None = None, handle_unknown: str = "error") -> DataFrame:
    """A 0/1 column for every category, in order; an unknown value is an error or all zeros.

    The categories become columns, so there are at most MOST_COLUMNS of them: more are an error.
    """
    values = _few(df, column) if values is None else values
    c = F.col(column)
    known = c.isin(values) | c.isNull()
    guard = F.lit(True) if handle_unknown == "ignore" else F.when(known, True).otherwise(F.raise_error(F.lit("unknown category")).cast("boolean"))
    return df.withColumns({f"{column}={v}": (F.coalesce(c == v, F.lit(False)) & guard).cast("double") for v in values})


def label_binarize(df: DataFrame, column: str) -> DataFrame:
    """One 0/1 column per class, or a single one where there are two classes."""
    values = _few(df, column)
    keep = values[1:] if len(values) == 2 else values
    return df.withColumns({f"{column}={v}": (F.col(column) == v).cast("int") for v in keep})


def impute(df: DataFrame, columns: list[str], strategy: str = "mean", fill_value=None) -> DataFrame:
    """Missing (null or NaN) values replaced by the mean, median, most frequent (smallest of ties) or a constant."""
    if strategy == "constant":
        found = dict.fromkeys(columns, fill_value)
    elif strategy == "most_frequent":
        found = {}
        for c in columns:
            top = df.select(clean(c).alias("v")).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").first()
            found[c] = top.v if top else None
    else:
        q = percentiles(df, {c: clean(c) for c in columns}, [0.5]) if strategy == "median" else {}
        found = {c: q[c][0] for c in columns} if q else _stats(df, columns, v=F.avg)["v"]
    return df.withColumns({c: F.coalesce(clean(c), F.lit(found[c]).cast("double")) for c in columns})


def missing_indicator(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": clean(c).isNull() for c in columns})


def function_transform(df: DataFrame, functions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Columns replaced by column functions of themselves."""
    return df.withColumns({c: f(F.col(c)) for c, f in functions.items()})


def variance_threshold(df: DataFrame, columns: list[str], threshold: float = 0.0) -> list[str]:
    """The columns whose population variance is above the threshold."""
    v = _stats(df, columns, v=F.var_pop)["v"]
    return [c for c in columns if (v[c] or 0.0) > threshold]


def winsorize(df: DataFrame, columns: list[str], lower: float = 5.0, upper: float = 95.0) -> DataFrame:
    """Values clipped to two exact percentiles."""
    s = percentiles(df, {c: clean(c) for c in columns}, [lower / 100, upper / 100])
    return df.withColumns({c: F.greatest(F.lit(s[c][0]), F.least(F.lit(s[c][1]), F.col(c))) for c in columns})


def cyclical(df: DataFrame, column: str, period: float) -> DataFrame:
    angle = F.col(column) * (2 * 3.141592653589793 / period)
    return df.withColumns({f"{column}_sin": F.sin(angle), f"{column}_cos": F.cos(angle)})


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """Calendar parts of a timestamp (Monday = 0), a weekend flag, and sine and cosine of month, day and hour."""
    c = F.col(column)
    parts = {
        "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "dow": F.weekday(c), "doy": F.dayofyear(c),
        "hour": F.hour(c), "quarter": F.quarter(c), "weekend": (F.weekday(c) >= 5).cast("int"),
    }
    out = df.withColumns(parts)
    for name, period in (("month", 12), ("dow", 7), ("hour", 24)):
        out = cyclical(out, name, period)
    return out


def rbf_sample(df: DataFrame, columns: list[str], weights: list[list[float]], offsets: list[float]) -> DataFrame:
    """Random Fourier features: sqrt(2 / m) * cos(w.x + b) for given weights, one list per feature."""
    m = len(weights)
    return df.withColumns({
        f"rff{i}": (2 / m) ** 0.5 * F.cos(sum((F.col(c) * w for c, w in zip(columns, ws, strict=True)), F.lit(b)))
        for i, (ws, b) in enumerate(zip(weights, offsets, strict=True))
    })


def random_projection(df: DataFrame, columns: list[str], matrix: list[list[float]]) -> DataFrame:
    """Dot products of the rows with each row of a matrix."""
    return df.withColumns({
        f"rp{i}": sum((F.col(c) * w for c, w in zip(columns, ws, strict=True)), F.lit(0.0)) for i, ws in enumerate(matrix)
    })
