"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or where that is unset in local mode (as in tests) a folder of the driver's own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    root = "file://" + tempfile.mkdtemp(prefix="halyard-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/halyard-{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit; the folder is scratch space
        pass


def spooled(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """The rows with their places from 0 in ``order``, which no single task sees whole.

    The rows are dealt out by range, sorted and written once with their part and row, so that both readers below see the
    same parts; the parts' sizes, a row each, shift their rows. Rows equal in ``order`` get places in any order."""
    spark, at, part = df.sparkSession, f"at_{uuid.uuid4().hex}", f"part_{uuid.uuid4().hex}"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the id is the part times 2^33, and the row in it
    lined = spooled(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    lined = lined.withColumn(part, F.shiftright(at, 33))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = lined.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    shifts = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    placed = lined.join(F.broadcast(shifts), part)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("shift") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
