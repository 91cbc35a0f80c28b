"""Tables and versions in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session's own in spark.checkpoint.dir, which goes when the driver ends. Where none is named, a local
    session (tests) gets one of its machine's and a cluster an error, for its executors would not share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docketspark-"))  # Spark makes a new folder in it
        path, fs = hadoop_path(spark, sc.getCheckpointDir())
        fs.deleteOnExit(path)
    return sc.getCheckpointDir()


def hadoop_path(spark: SparkSession, path: str):  # noqa: ANN201
    """(path, file system) of any path that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """`df`, computed once, written to the shared folder and read again: later plans know its size, and lost executors don't undo it.

    The files go when the driver ends.
    """
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path, fs = hadoop_path(spark, name)
    fs.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(name)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any longer; others are left alone."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path, fs = hadoop_path(spark, folder)
        if path.getName().startswith("kept-") and hadoop_path(spark, shared_folder(spark))[0].toUri().getPath() == path.getParent().toUri().getPath():
            fs.delete(path, True)
