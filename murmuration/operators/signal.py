"""Spectra, wavelets and warped distances of series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered


def periodogram(df: DataFrame, value: str, order: list, by: list[str], frequencies: list[int]) -> DataFrame:
    """(by..., k, power): squared size of the discrete Fourier transform at whole cycles k over a series, by its length.

    The wanted frequencies are a parameter; each is two sums over the series, so no series is gathered.
    """
    placed = numbered(df, order, by)
    angle = F.col("_at") * F.col("k") * (2 * math.pi) / F.col("_n")
    waves = placed.withColumn("k", F.explode(F.array(*map(F.lit, frequencies))))
    sums = waves.groupBy(*by, "k").agg(F.sum(F.col(value) * F.cos(angle)).alias("c"), F.sum(F.col(value) * F.sin(angle)).alias("s"), F.max("_n").alias("n"))
    return sums.select(*by, "k", ((F.col("c") ** 2 + F.col("s") ** 2) / F.col("n")).alias("power"))


def haar(df: DataFrame, value: str, order: list, by: list[str], levels: int = 1) -> DataFrame:
    """(by..., level, at, smooth, detail): sums and differences of neighbours over sqrt 2, level by level.

    A row without a partner at the end of a level is left out of the next one.
    """
    current = numbered(df, order, by).select(*by, F.col("_at").alias("at"), F.col(value).cast("double").alias("v"))
    out = None
    for level in range(1, levels + 1):
        pair = current.groupBy(*by, F.floor(F.col("at") / 2).alias("at")).agg(
            F.sum(F.when(F.col("at") % 2 == 0, F.col("v"))).alias("a"), F.sum(F.when(F.col("at") % 2 == 1, F.col("v"))).alias("b")
        ).where("a IS NOT NULL AND b IS NOT NULL")
        found = pair.select(*by, F.lit(level).alias("level"), "at", ((F.col("a") + F.col("b")) / math.sqrt(2)).alias("smooth"), ((F.col("a") - F.col("b")) / math.sqrt(2)).alias("detail"))
        out = found if out is None else out.unionByName(found)
        current = found.select(*by, "at", F.col("smooth").alias("v"))
    return out


def warped_distance(a: Column, b: Column) -> Column:
    """Dynamic time warping of two arrays of numbers: the least sum of gaps over all monotone alignments.

    For short series: the work is the product of the lengths, folded row by row.
    """
    far = F.lit(float("inf"))
    marks = F.transform(b, lambda y, j: F.struct(y.cast("double").alias("y"), j.alias("j")))
    top = F.concat(F.array(F.lit(0.0)), F.transform(b, lambda y: far))

    def row(above: Column, x: Column) -> Column:
        def cell(row: Column, e: Column) -> Column:
            least = F.least(F.get(above, e["j"]), F.get(above, e["j"] + 1), F.get(row, e["j"]))
            return F.array_append(row, F.abs(x.cast("double") - e["y"]) + least)

        return F.aggregate(marks, F.array(far), cell)

    return F.aggregate(a, top, row, lambda last: F.element_at(last, -1))
