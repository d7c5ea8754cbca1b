"""Streaming twins: the same measurements over events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """New Parquet files of a folder of events."""
    s = spark.readStream.schema(SCHEMA.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", files).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def hopping_levels(events: DataFrame, window: str = "2 hours", hop: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """RMS and peak per window and user; windows close when the watermark has passed them."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window, hop), "user_id")
    return g.agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max("value").alias("peak"), F.count("*").alias("n"))


def loud_sessions(events: DataFrame, threshold: float, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs of values over a threshold, merged while they are less than ``gap`` apart."""
    up = events.where(F.col("value") > threshold).withWatermark("ts", late)
    return up.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
