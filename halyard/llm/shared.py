"""Helpers that several training-data operators use: table access, scratch tables and file systems."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from halyard.scratch import remove_path, scratch_path
from halyard.sources.backups import open_fs

__all__ = ["discard", "open_fs", "partitions", "release", "remove_path", "scratch_path", "stored", "table", "trim_worker"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: lineage ends there, so a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's garbage is collected; without this, those of all steps pile up."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def discard(df: DataFrame) -> None:
    """Removes a table that ``stored`` wrote and nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        if "/halyard-" in name:
            remove_path(df.sparkSession, name)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def trim_worker() -> None:
    """Gives a Python worker's freed memory back at the end of a task: workers live on and share an executor."""
    import ctypes
    import sys

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
