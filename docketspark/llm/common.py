"""Small helpers that the text operators share."""

from __future__ import annotations

import gc
import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.sources.store import shared_folder, stored

__all__ = ["shared_folder", "stored"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder, so that lost executors don't undo it."""
    shared_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    if next(_calls) % 3 == 2:
        freed(df.sparkSession)
    return kept


_calls = itertools.count()


def freed(spark: SparkSession) -> None:
    """Has the driver collect plans that nothing refers to any longer; Spark then deletes their shuffle files, and their checkpoints
    where spark.cleaner.referenceTracking.cleanCheckpoints is on. What is left goes with the session's folder, when the driver ends."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, records: int = 1000, mb: int = 4) -> None:
    """Sets the session's Arrow batches to at most so many rows and about so many MB, if they are larger:
    what a Python worker holds of long texts depends on it."""
    name, most = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name)) <= records:
        spark.conf.set(name, str(records))
    spark.conf.set(most, f"{mb}m")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(rows: int, rows_each: int, least: int = 1) -> int:
    """Number of partitions that hold about `rows_each` rows."""
    return max(least, math.ceil(rows / rows_each))
