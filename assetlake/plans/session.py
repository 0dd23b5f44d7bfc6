"""Session access: tables, the shared folder, durable intermediates."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The same as passing it with --py-files; Spark copies the archive to every executor.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root = Path(__file__).resolve().parents[2]
        base = Path(tempfile.mkdtemp(prefix="assetlake-package-")) / "assetlake"
        archive = shutil.make_archive(str(base), "zip", root, "assetlake")
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local master may fall back to a temporary folder.
    """
    named = spark.conf.get(SHARED_DIR, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SHARED_DIR} to a folder shared by all executors")
    named = tempfile.mkdtemp(prefix="assetlake-")
    spark.conf.set(SHARED_DIR, named)
    return named


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so a lost executor cannot change what was computed."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder once and read back; `df` runs a single time."""
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
