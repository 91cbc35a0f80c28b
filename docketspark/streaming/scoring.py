"""Requests scored as they arrive: a stateless stream joined with the artifact's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketspark.operators.serving import Artifact, score_baseline, score_batch


def read_requests(spark: SparkSession, folder: str, schema: str, files_each: int = 100) -> DataFrame:
    """New Parquet files of a folder, at most `files_each` per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def scored_stream(requests: DataFrame, artifact: Artifact, model=None) -> DataFrame:
    return score_baseline(requests, artifact) if model is None else score_batch(requests, artifact, model)


def write_scores(scores: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, exactly once; stops when what is there has been read."""
    return scores.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_rates(requests: DataFrame, late: str = "3 days") -> DataFrame:
    """Requests and labels per agency and day, kept until `late` after the day, then emitted."""
    return (
        requests.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "agency")
        .agg(F.count("*").alias("n"), F.sum("y").alias("positives")).select("agency", F.to_date("window.start").alias("reg"), "n", "positives")
    )
