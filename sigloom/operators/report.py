"""The A/B quality report and its verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.numeric import CLIPPED, correlation, db, rms_db
from sigloom.operators.levels import frame_power
from sigloom.operators.spectral import BANDS

#: Gain bins of 6 dB from -100 to -4 dB with 12 frames at least, and the limits of the verdict.
BIN_LOW, BIN_HIGH, BIN_DB, BIN_FRAMES = -100, -4, 6, 12
DURATION_MS, DRIFT_MS, CORR_MIN, BAND_DB, SLOPE_DROP, SPREAD_DB = 5.0, 5.0, 0.90, 1.5, -0.5, 6.0


def gain_curve(levels: DataFrame, least: int = BIN_FRAMES) -> DataFrame:
    """(sig, bin, gain, n): median gain by the level of a; levels (sig, da, db)."""
    b = levels.where((F.col("da") >= BIN_LOW) & (F.col("da") < BIN_HIGH)).withColumn("bin", (F.floor((F.col("da") - BIN_LOW) / BIN_DB) * BIN_DB + BIN_LOW).cast("long"))
    return b.groupBy("sig", "bin").agg(F.median(F.col("db") - F.col("da")).alias("gain"), F.count("*").alias("n")).where(F.col("n") >= least)


def dynamics(ab: DataFrame, window: int = 2048, hop: int = 512, least: int = BIN_FRAMES) -> DataFrame:
    """(sig, spread, quiet, loud): height of the gain curve over frames, and the gain of its lowest and highest level; ab (sig, i, a, b).

    Signals without a bin of ``least`` frames have no row.
    """
    side = lambda c: frame_power(ab.select("sig", "i", F.col(c).alias("x")), window, hop, last=False).select("sig", "frame", rms_db(F.col("power")).alias(f"d{c}"))
    curve = gain_curve(side("a").join(side("b"), ["sig", "frame"]), least)
    return curve.groupBy("sig").agg((F.max("gain") - F.min("gain")).alias("spread"), F.min_by("gain", "bin").alias("quiet"), F.max_by("gain", "bin").alias("loud"))


def transients(ab: DataFrame, onsets: DataFrame, pre: int, gap: int, post: int, tail: tuple[int, int] | None = None) -> DataFrame:
    """(sig, n, slope_a, slope_b): median attack slopes of both signals around a's onsets; with ``tail`` also decay_a and decay_b.

    ab (sig, i, a, b), onsets (sig, o). A slope is the level of [o, o + post) over that of [o - pre, o - gap). A decay is the
    level of [o + tail[0], tail[1] samples) over that of [o, o + post). Each sample finds its onsets by position, through the few
    offsets that can reach it.
    """
    reach = [F.sequence(F.col("o") - pre, F.col("o") + post - 1)]
    if tail:
        reach.append(F.sequence(F.col("o") + tail[0], F.col("o") + sum(tail) - 1))
    spots = onsets.select("sig", "o", F.explode(F.array_distinct(F.concat(*reach))).alias("i"))
    s = spots.join(ab, ["sig", "i"]).withColumn("d", F.col("i") - F.col("o"))
    parts = {0: F.col("d") < -gap, 1: (F.col("d") >= 0) & (F.col("d") < post), 2: F.lit(False)}
    if tail:
        parts[2] = (F.col("d") >= tail[0]) & (F.col("d") < sum(tail))
    power = lambda c, k: F.avg(F.when(parts[k], F.col(c) * F.col(c)))
    g = s.groupBy("sig", "o").agg(*(power(c, k).alias(f"{c}{k}") for c in "ab" for k in parts))
    change = lambda c, to, of: rms_db(F.col(f"{c}{to}")) - rms_db(F.col(f"{c}{of}"))
    g = g.where("a0 is not null and a1 is not null or a1 is not null and a2 is not null")
    g = g.select("sig", *(x.alias(f"{n}{c}") for c in "ab" for n, x in (("s", change(c, 1, 0)), ("d", change(c, 2, 1)))))
    out = g.groupBy("sig").agg(F.count("sa").alias("n"), *(F.median(f"{k}{c}").alias(f"{n}_{c}") for n, k in (("slope", "s"), ("decay", "d")) for c in "ab"))
    return out if tail else out.where("n > 0").drop("decay_a", "decay_b")


def local_fine(ab: DataFrame, window: int) -> DataFrame:
    """(sig, w, corr): correlation of a and b in windows side by side; short ones are left out."""
    g = ab.groupBy("sig", F.expr(f"k div {window}").alias("w")).agg(correlation("a", "b").alias("corr"), F.count("*").alias("n"))
    return g.where(F.col("n") == window).select("sig", "w", F.coalesce("corr", F.lit(0.0)).alias("corr"))


def quality_report(ab: DataFrame, window: int = 8, frame: int = 2048, hop: int = 512) -> DataFrame:
    """One row per pair of signals; ab (sig, k, t, a, b), aligned. The gain curve takes frames of ``frame`` samples."""
    w = Window.partitionBy("sig").orderBy("k")
    d = ab.withColumns({"ja": F.abs(F.col("a") - F.lag("a").over(w)), "jb": F.abs(F.col("b") - F.lag("b").over(w))})
    rms = lambda x: F.sqrt(F.avg(x * x))
    g = d.groupBy("sig").agg(
        F.count("*").alias("n"), F.max("t").alias("duration"), F.max(F.abs("a")).alias("peak_a"), F.max(F.abs("b")).alias("peak_b"),
        F.sum(F.when(F.abs("a") >= CLIPPED, 1).otherwise(0)).cast("long").alias("clipped_in"), F.sum(F.when(F.abs("b") >= CLIPPED, 1).otherwise(0)).cast("long").alias("clipped_out"),
        rms(F.col("a")).alias("ra"), rms(F.col("b")).alias("rb"), rms(F.col("a") - F.col("b")).alias("rd"),
        F.median(F.when((F.col("a") != 0) & (F.col("b") != 0), 20 * F.log10(F.abs(F.col("b") / F.nullif("a", F.lit(0.0)))))).alias("program_gain"),
        (F.max("ja") / F.nullif(F.max(F.abs("a")), F.lit(0.0))).alias("step_a"), (F.max("jb") / F.nullif(F.max(F.abs("b")), F.lit(0.0))).alias("step_b"),
        F.coalesce(correlation("a", "b"), F.lit(1.0)).alias("corr"),
    )
    curve = dynamics(ab.select("sig", F.col("k").alias("i"), "a", "b"), frame, hop)
    fine = local_fine(ab, window).groupBy("sig").agg(F.min("corr").alias("corr_min"), F.median("corr").alias("corr_median"))
    out = g.join(curve, "sig", "left").join(fine, "sig", "left")
    residual = F.when((F.col("rd") > 0) & (F.col("ra") > 0), db(F.col("rd")) - db(F.col("ra"))).otherwise(F.lit(float("-inf")))
    return out.select(
        "sig", "n", "duration", "peak_a", "peak_b", "clipped_in", "clipped_out", (db(F.col("rb")) - db(F.col("ra"))).alias("rms_delta"),
        residual.alias("residual"), "program_gain", "step_a", "step_b", "corr", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("spread", "quiet", "loud")), "corr_min", "corr_median",
    )


def with_measures(report: DataFrame, lengths: DataFrame, offsets: DataFrame, bands: DataFrame, slopes: DataFrame) -> DataFrame:
    """``report`` with channels_a, channels_b, duration_delta_ms, drift_ms, bands (a map) and slope_delta.

    lengths (sig, channels_a, channels_b, end_a, end_b) in seconds; offsets (sig, w, ms); bands (sig, band, delta);
    slopes (sig, slope_a, slope_b). What a table has no row for is null.
    """
    size = lengths.select("sig", "channels_a", "channels_b", (1000 * (F.col("end_b") - F.col("end_a"))).alias("duration_delta_ms"))
    drift = offsets.groupBy("sig").agg((F.max("ms") - F.min("ms")).alias("drift_ms"))
    moved = bands.groupBy("sig").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("band", "delta")))).alias("bands"))
    attack = slopes.select("sig", (F.col("slope_b") - F.col("slope_a")).alias("slope_delta"))
    return report.join(size, "sig", "left").join(drift, "sig", "left").join(moved, "sig", "left").join(attack, "sig", "left")


def verdict(report: DataFrame) -> DataFrame:
    """(sig, problems, passed): what a report with measures fails, in a fixed order; a plain change of gain is no problem.

    A band counts if its low edge is in 100 to 10,000 Hz. What wasn't measured (null, or no column) raises no problem.
    """
    measures = {"channels_a": "int", "channels_b": "int", "duration_delta_ms": "double", "drift_ms": "double", "bands": "map<string,double>", "slope_delta": "double"}
    report = report.withColumns({c: F.lit(None).cast(t) for c, t in measures.items() if c not in report.columns})
    in_range = [name for name, low, _ in BANDS if 100 <= low <= 10_000]
    bad = lambda name: F.when(F.abs(F.try_element_at("bands", F.lit(name))) > BAND_DB, f"band {name}")
    found = [
        F.when(F.col("channels_a") != F.col("channels_b"), "channels"), F.when(F.abs("duration_delta_ms") > DURATION_MS, "duration"),
        F.when(F.col("drift_ms") > DRIFT_MS, "drift"), F.when(F.col("corr_min") < CORR_MIN, "corr_min"), *map(bad, in_range),
        F.when(F.col("slope_delta") < SLOPE_DROP, "attack slope"), F.when(F.col("spread") > SPREAD_DB, "spread"),
        F.when(F.col("clipped_out") > F.col("clipped_in"), "clipping"),
    ]
    problems = F.array_compact(F.array(*found))
    return report.select("sig", F.array_join(problems, ",").alias("problems"), (F.size(problems) == 0).alias("passed"))


def batch_verdict(verdicts: DataFrame) -> DataFrame:
    """(n, failed, passed): one row; an empty batch passes."""
    return verdicts.agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))
