"""Inputs of the registered queries, as DataFrames and as the same DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: A scored sample: every line item with a 0/1 truth, a score, a prediction, groups and two labels.
SCORED_COLUMNS = {
    "id": "l_orderkey * 10 + l_linenumber",
    "y": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "score": "l_discount * 4 + l_tax * 4 + l_quantity / 200",
    "p": "CASE WHEN l_discount + l_tax > 0.09 THEN 1 ELSE 0 END",
    "g": "l_linestatus",
    "label": "l_returnflag",
    "guess": "CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END",
    "q": "l_quantity",
    "price": "l_extendedprice",
    "disc": "l_discount",
    "tax": "l_tax",
    "brand": "l_partkey % 25",
    "ts": "l_shipdate",
}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    out = df.selectExpr(*[f"{e} AS {n}" for n, e in SCORED_COLUMNS.items()])
    return out.withColumn("brand", F.col("brand").cast("long"))


SCORED = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in SCORED_COLUMNS.items()) + " FROM lineitem)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, with no negative zero: what both engines agree on."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + 0.0).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`")
        for f in df.schema
    ])


class Catalog:
    """Queries and their SQL twins by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(
        self,
        name: str,
        query: Callable[[SparkSession, str], DataFrame],
        sql: str | None = None,
        floats: str = "",
        ints: str = "",
        digits: int = 6,
    ) -> None:
        """`floats` and `ints` name the columns of the SQL result to round, and to read as 64-bit integers."""
        self.queries[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
        if sql is None:
            return
        cast = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in floats.split()]
        cast += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
        self.oracles[name] = f"SELECT * REPLACE ({', '.join(cast)}) FROM ({sql})" if cast else sql
