"""Putting a decision per row back onto the whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, sized

#: The column that names a row while a stage decides; not a name that documents have.
ROW = "__murmuration_row"


def with_rows(docs: DataFrame) -> DataFrame:
    """The table with a long of its own for every row, written once so that it reads the same each time."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def with_ids(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): an id for each row that orders as `id_col` does, nulls last, and names one row."""
    return rows.select(
        F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("name"), F.col(ROW).alias("row")).alias("id"),
        F.col(text_col).alias("text"),
    )


def keep_numbered(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of `with_rows` that `decided` (row, kept) does not drop, without the column of row numbers.

    The dropped ones are joined, broadcast only if they have been counted and are few.
    """
    # Written whole: a filter pushed below the decision would compute it anew for each of its conditions.
    decided = materialize(decided.select("row", "kept"), "decided")
    gone = decided.where("not kept").select(F.col("row").alias(ROW))
    return rows.join(sized(gone), ROW, "left_anti").drop(ROW)
