"""The test tables as signals, beats, frames and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sig, k, t, x): a signal per user, t in seconds from the user's first event, x the value over 500."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sig"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", (F.col("value") / 500).alias("x")
    )
    order = Window.partitionBy("sig").orderBy("us", "event_id")
    first = F.min("us").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return e.select("sig", (F.row_number().over(order) - 1).cast("long").alias("k"), ((F.col("us") - first) / 1e6).alias("t"), "x")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sig, i, x): one long signal, in two halves of odd and even hundreds of thousands, by event number."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit(0).cast("long").alias("sig"), F.col("event_id").alias("i"), (F.col("value") / 500).alias("x"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, frame, x): an array of 64 samples for each vector; the label names the stem."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("stem"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, i, l, r): vectors 2k and 2k+1 as the channels of pair k, a row a sample."""
    e = frames(spark, sf_dir).select(F.expr("frame div 2").alias("pair"), (F.col("frame") % 2).alias("ch"), F.posexplode("x").alias("i", "x"))
    both = e.groupBy("pair", F.col("i").cast("long").alias("i")).agg(F.max(F.when(F.col("ch") == 0, F.col("x"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("x"))).alias("r"))
    return both.where("l is not null and r is not null")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sig, k, onset, dur, pitch, instrument): a note per event, lasting to the user's next one, 4 seconds at most."""
    e = beats(spark, sf_dir)
    gap = F.lead("t").over(Window.partitionBy("sig").orderBy("k")) - F.col("t")
    code = F.floor(F.col("x") * 500)
    return e.select("sig", "k", F.col("t").alias("onset"), F.least(F.coalesce(gap, F.lit(1.0)), F.lit(4.0)).alias("dur"), (code % 128).cast("long").alias("pitch"), F.expr("floor(x * 500) div 128").cast("long").alias("instrument"))
