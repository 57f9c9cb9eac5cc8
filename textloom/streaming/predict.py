"""Streams: the batch dataflow on a stream of documents, and counts over event time (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.classify import Scorer
from textloom.operators.predict import predictions
from textloom.sources.tables import REQUESTS


def stream_requests(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Requests from Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(REQUESTS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def stream_predictions(requests: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """The same plan as in batch: no state, so it runs in append mode."""
    return predictions(requests, None, scorer)


def write_available(df: DataFrame, path: str, checkpoint: str):
    """Everything there is now, each file once, then the query ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))


def user_sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user, closed by a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
