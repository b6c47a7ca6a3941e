"""Session helpers shared by the entry points, the bench and the tests."""

from __future__ import annotations

import os
import zipfile
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "murmuration") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("MURMURATION_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers when their path does not hold it already."""
    sc = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if ROOT in paths or getattr(sc, "_murmuration_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="murmuration-")) / "murmuration.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (ROOT / "murmuration").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._murmuration_shipped = True
