"""Likeness of two strings as column expressions: edit tables folded row by row, and matched characters.

Meant for names and codes: the work is the product of the two lengths. Null strings give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _indexed(chars: Column) -> Column:
    return F.transform(chars, lambda y, j: F.struct(y.alias("y"), j.alias("j")))


def _corner(a: Column, b: Column, edge: int, cell: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """The last value of the table over two strings' characters."""
    return _table(characters(a), characters(b), edge, cell)


def _table(a: Column, b: Column, edge: int, cell: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """The last value of a table whose edges grow by `edge`; cell(diagonal, above, left, same item) gives the rest."""
    marks = _indexed(b)
    top = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j * edge)

    def row(above: Column, x: Column) -> Column:
        return F.aggregate(
            marks,
            F.array(above[0] + edge),
            lambda row, e: F.array_append(row, cell(F.get(above, e["j"]), F.get(above, e["j"] + 1), F.get(row, e["j"]), e["y"] == x)),
        )

    return F.aggregate(a, top, row, lambda last: F.element_at(last, -1))


def subsequence_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays."""
    return _table(a, b, 0, lambda diagonal, above, left, same: F.when(same, diagonal + 1).otherwise(F.greatest(above, left)))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    return _corner(a, b, 0, lambda diagonal, above, left, same: F.when(same, diagonal + 1).otherwise(F.greatest(above, left)))


def needleman_wunsch(a: Column, b: Column, match: int = 1, mismatch: int = -1, gap: int = -1) -> Column:
    """Score of the best global alignment."""
    return _corner(
        a, b, gap, lambda diagonal, above, left, same: F.greatest(diagonal + F.when(same, match).otherwise(mismatch), above + gap, left + gap)
    ).cast("double")


def damerau_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance where a swap of two neighbours is one edit too, and nothing is edited twice."""
    chars = characters(b)
    start = F.struct(
        F.array().cast("array<int>").alias("before"), F.sequence(F.lit(0), F.length(b)).alias("row"), F.lit("").alias("seen")
    )

    def row(state: Column, x: Column) -> Column:
        def cell(row: Column, e: Column) -> Column:
            j = e["j"]
            plain = F.least(F.get(state["row"], j + 1) + 1, F.get(row, j) + 1, F.get(state["row"], j) + (e["y"] != x).cast("int"))
            swap = F.when((state["seen"] == e["y"]) & (F.get(chars, j - 1) == x), F.get(state["before"], j - 1) + 1)
            return F.array_append(row, F.least(plain, swap))

        new = F.aggregate(_indexed(chars), F.array(state["row"][0] + 1), cell)
        return F.struct(state["row"].alias("before"), new.alias("row"), x.alias("seen"))

    return F.aggregate(characters(a), start, row, lambda s: F.element_at(s["row"], -1))


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity; equal strings (empty ones too) have 1."""
    chars = characters(b)
    reach = F.floor(F.greatest(F.length(a), F.length(b)) / 2) - 1
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("mine"))

    def match(state: Column, e: Column) -> Column:
        free = F.filter(
            _indexed(chars),
            lambda f: (f["y"] == e["y"]) & (F.abs(f["j"] - e["j"]) <= reach) & ~F.array_contains(state["taken"], f["j"]),
        )
        at = F.get(free, F.lit(0))["j"]
        more = F.struct(F.array_append(state["taken"], at).alias("taken"), F.array_append(state["mine"], e["y"]).alias("mine"))
        return F.when(at.isNull(), state).otherwise(more)

    def score(state: Column) -> Column:
        m = F.size(state["taken"])
        theirs = F.transform(F.array_sort(state["taken"]), lambda j: F.get(chars, j))
        moved = F.size(F.filter(F.zip_with(state["mine"], theirs, lambda x, y: x != y), lambda d: d))
        return F.when(m == 0, 0.0).otherwise((m / F.length(a) + m / F.length(b) + (m - F.floor(moved / 2)) / m) / 3)

    return F.when(a == b, 1.0).otherwise(F.aggregate(_indexed(characters(a)), start, match, score))


def jaro_winkler(a: Column, b: Column, weight: float = 0.1, longest: int = 4) -> Column:
    """Jaro similarity, raised for a common prefix of up to `longest` characters."""
    same = [F.when((F.length(a) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k)), 1).otherwise(0) for k in range(1, longest + 1)]
    prefix = sum(same[1:], same[0])
    j = jaro(a, b)
    return j + prefix * weight * (1 - j)
