"""Channels, contracts between stages, stem sums and repairs that are kept or rolled back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.numeric import clip, first_best


def match_channels(s: DataFrame, channels: int) -> DataFrame:
    """(sig, ch, i, x) with as many channels: unchanged if they agree, the mean for one, the mean repeated otherwise."""
    count = F.max("ch").over(Window.partitionBy("sig")) + 1
    s = s.withColumn("n", count)
    mean = s.where(F.col("n") != channels).groupBy("sig", "i").agg(F.avg("x").alias("x"))
    spread = mean.select("sig", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(channels - 1).cast("long"))).alias("ch"), "i", "x")
    return s.where(F.col("n") == channels).select("sig", F.col("ch").cast("long").alias("ch"), "i", "x").unionByName(spread)


def apply_delta(source: DataFrame, delta: DataFrame) -> DataFrame:
    """(sig, ch, i, x): a mono repair's change (sig, i, d), at the source's rate, added to every channel, clipped to 1.

    Samples the change doesn't reach stay; what reaches past the source is dropped.
    """
    return source.join(delta, ["sig", "i"], "left").select("sig", "ch", "i", clip(F.col("x") + F.coalesce("d", F.lit(0.0)), -1.0, 1.0).alias("x"))


def check_stage(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sig, problem): stems that a stage lost, made up or whose channel count it changed; (sig, channels) on each side."""
    both = before.select("sig", F.col("channels").alias("a")).join(after.select("sig", F.col("channels").alias("b")), "sig", "full")
    problem = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "channels")
    return both.select("sig", problem.alias("problem")).where("problem is not null")


def require_stage(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``; reading it fails where a stem's channel count isn't that of ``before``."""
    known = before.select("sig", F.col("channels").alias("__want"))
    joined = after.join(known, "sig", "left")
    broken = F.raise_error(F.concat(F.lit("channel count changed: "), F.col("sig").cast("string")))
    kept = F.when(F.col("channels").eqNullSafe(F.col("__want")), F.col("channels")).otherwise(broken.cast("long"))
    return joined.withColumn("channels", kept).drop("__want")


def stem_summary(stems: DataFrame, mix: DataFrame) -> DataFrame:
    """(sig, target, error): the loudest stem, the first on ties, and the level of (sum of stems - mix) over the mix.

    stems (sig, stem, i, x), mix (sig, i, m). A silent mix has no error.
    """
    loud = stems.groupBy("sig", "stem").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    loud = loud.groupBy("sig").agg(first_best(F.col("stem"), F.round("rms", 9), F.col("stem")).alias("target"))
    total = stems.groupBy("sig", "i").agg(F.sum("x").alias("y")).join(mix, ["sig", "i"])
    off = F.col("y") - F.col("m")
    error = total.groupBy("sig").agg((F.sqrt(F.avg(off * off)) / F.nullif(F.sqrt(F.avg(F.col("m") * F.col("m"))), F.lit(0.0))).alias("error"))
    return loud.join(error, "sig", "left")


def masked_mean(f: DataFrame, region: DataFrame, dt: float, value: str) -> DataFrame:
    """(sig, mean): mean of a frame column inside each half-open region (sig, start, end); null without a frame."""
    inside = f.join(region, "sig").where((F.col("k") * dt >= F.col("start")) & (F.col("k") * dt < F.col("end")))
    return region.select("sig").join(inside.groupBy("sig").agg(F.avg(value).alias("mean")), "sig", "left")


def keep_if_better(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sig, before, after, kept): a repair is kept only where the measured risk (sig, mean) fell; else it is undone."""
    both = before.withColumnRenamed("mean", "before").join(after.withColumnRenamed("mean", "after"), "sig", "left")
    return both.select("sig", "before", "after", F.coalesce(F.col("after") < F.col("before"), F.lit(False)).alias("kept"))


def target_bpm(interval):
    """Beats a minute of an interval in seconds; NaN for 0."""
    return F.when(interval == 0, F.lit(float("nan"))).otherwise(60 / F.nullif(interval, F.lit(0.0)))


def hz_label(hz):
    """Hertz as text without a fraction; none for null and 0."""
    return F.when(hz.isNull() | (hz == 0), "none").otherwise(F.format_string("%.0fHz", F.rint(hz.cast("double"))))


def percent_label(share):
    """A percentage as text with two places; a dash for null."""
    return F.when(share.isNull(), "\u2014").otherwise(F.format_string("%.2f%%", share.cast("double")))


def output_rate(source, setting):
    """The configured sample rate, the source's where 0 or nothing is configured."""
    return F.coalesce(F.nullif(setting, F.lit(0)), source)
