"""Tables that a job writes between its steps, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where a local session has none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="murmuration-shared-"))
    return f"{named.rstrip('/')}/murmuration-{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table or file set in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and survives lost executors.

    The shuffle files behind it are released as soon as the table stands.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame):
    """The rows of a bounded table as an Arrow table; the shuffle files behind it are released at once."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.toArrow()
    finally:
        spark.conf.set(_CLEANUP, before)


def placed(df: DataFrame, key: str, name: str = "placed") -> DataFrame:
    """A table that rounds join by one key: written, then dealt by that key once and kept on the executors' disks.

    Joins by the key find its rows where they are. What an executor loses is read and dealt again. To be unpersisted.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(df, name).repartition(parts, key).persist(StorageLevel.DISK_ONLY)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A side is broadcast up to this many rows of a few longs each (some 50 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The side of a join with a broadcast hint if it has been counted and is small, as it is otherwise."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")
