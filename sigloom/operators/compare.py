"""One report of a processed signal against its original: alignment, levels, bands, transients, dynamics, stereo and artifacts.

Signals come as rows (sig, ch, x array<double>), a row a channel. Every axis is a table by ``sig`` of its own operator; here they
are fed with each other's results (what is measured after alignment gets the pair that the offset search leaves) and joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.numeric import correlation
from sigloom.operators import kernels, levels, pitch, report, spectral, timing
from sigloom.sources.interim import stored


@dataclass(frozen=True)
class Sizes:
    """Fixed values of a comparison, in seconds, Hz and samples."""

    envelope_hz: float = 200.0
    coarse_s: float = 15.0
    fine_s: float = 0.120
    material_s: float = 60.0
    window_s: float = 2.0
    hop_s: float = 1.0
    search_s: float = 0.250
    fine_window_s: float = 0.050
    n_fft: int = 2048
    hop: int = 512
    coherence: int = 8192
    hf_low: float = 10_000.0
    hf_high: float = 20_000.0
    least_s: float = 1.0


def mono_rows(channels: DataFrame, name: str) -> DataFrame:
    """(sig, i, name): the mean of the channels, a row a sample."""
    return channels.select("sig", F.posexplode("x").alias("i", "v")).groupBy("sig", F.col("i").cast("long").alias("i")).agg(F.avg("v").alias(name))


def aligned_rows(a: DataFrame, b: DataFrame, offsets: DataFrame) -> DataFrame:
    """(sig, i, a, b): the overlap of a (sig, i, a) and b (sig, i, b) after alignment, numbered from 0; offsets (sig, offset)."""
    moved = b.join(offsets, "sig").select("sig", (F.col("i") - F.col("offset")).alias("i"), "b", "offset")
    return a.join(moved, ["sig", "i"]).select("sig", (F.col("i") + F.least("offset", F.lit(0))).alias("i"), "a", "b")


def fine_at_offsets(a: DataFrame, b: DataFrame, tracked: DataFrame, hop: int, window: int) -> DataFrame:
    """(sig, fine_min, fine_median): correlation over short stretches at each tracked offset; tracked (sig, w, lag).

    Stretches that reach past either signal, or don't vary, are left out.
    """
    spots = tracked.select("sig", "w", "lag", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("j"))
    pairs = spots.withColumn("i", F.col("w") * hop + F.col("j")).join(a, ["sig", "i"]).withColumn("i", F.col("i") + F.col("lag")).join(b, ["sig", "i"])
    each = pairs.groupBy("sig", "w").agg(correlation("a", "b").alias("corr"), F.count("*").alias("n")).where((F.col("n") == window) & F.col("corr").isNotNull())
    return each.groupBy("sig").agg(F.min("corr").alias("fine_min"), F.median("corr").alias("fine_median"))


def stereo(channels: DataFrame, side: str) -> DataFrame:
    """(sig, channels_side, side_mid_side, lr_side): the number of channels, level of side over mid and the channels' correlation.

    With one channel these are minus infinity and 1.
    """
    count = channels.groupBy("sig").agg(F.count("*").alias(f"channels_{side}"))
    rows = channels.where("ch < 2").select(F.col("sig").alias("pair"), "ch", F.posexplode("x").alias("i", "v")).groupBy("pair", "i")
    lr = rows.agg(F.max(F.when(F.col("ch") == 0, F.col("v"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("v"))).alias("r")).where("r is not null")
    found = spectral.stereo_metrics(lr).select(F.col("pair").alias("sig"), F.col("side_mid_db").alias(f"side_mid_{side}"), F.col("corr").alias(f"lr_{side}"))
    return count.join(found, "sig", "left").fillna({f"side_mid_{side}": float("-inf"), f"lr_{side}": 1.0})


def compare(a: DataFrame, b: DataFrame, sr: int, sizes: Sizes = Sizes()) -> DataFrame:
    """One row per sig of both a and b (sig, ch, x), at one rate: every axis of the comparison, ready for :func:`report.verdict`.

    What can't be measured, for want of length or of variation, is null or zero as in the operator that measures it.
    """
    at = lambda seconds: int(seconds * sr)
    hop = max(1, round(sr / sizes.envelope_hz))
    ra, rb = (stored(mono_rows(s, n), f"mono-{n}") for s, n in ((a, "a"), (b, "b")))
    x = lambda rows, c: rows.select("sig", "i", F.col(c).alias("x"))
    offset = timing.estimate_offset(x(ra, "a"), x(rb, "b"), hop, int(sizes.coarse_s * sizes.envelope_hz), at(sizes.fine_s), None, at(sizes.material_s), at(sizes.least_s))
    offset = stored(offset, "offsets")
    ab = stored(aligned_rows(ra, rb, offset.select("sig", "offset")), "aligned")
    both = ra.join(rb, ["sig", "i"], "full").join(offset.select("sig", "offset"), "sig")
    tracked = stored(kernels.track_offsets(both, at(sizes.window_s), at(sizes.hop_s), at(sizes.search_s), "offset"), "tracked")
    times = timing.correlation_summary(tracked.select(F.col("sig").alias("pair"), F.col("lag").alias("start"), "score")).withColumnRenamed("pair", "sig")
    ms = lambda c: F.col(c) * 1000.0 / sr
    times = times.select("sig", "corr_min", "corr_median", "corr_mean", ms("drift").alias("drift_ms"), ms("max_offset").alias("max_offset_ms"), "confident")
    fine = fine_at_offsets(ra, rb, tracked, at(sizes.hop_s), at(sizes.fine_window_s))

    side = F.sort_array(F.collect_list(F.struct("i", "a", "b")))
    arrays = stored(ab.groupBy("sig").agg(side.alias("v")).select("sig", F.col("v.a").alias("x"), F.col("v.b").alias("y")), "pairs")
    spec = stored(spectral.dft(spectral.stft(arrays, sizes.n_fft, sizes.hop, "y"), sizes.n_fft, sr, second="y", window=spectral.hann(sizes.n_fft)), "spectra")
    bands = spectral.band_delta(spec, sr / 2).groupBy(F.col("stem").alias("sig"))
    bands = bands.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("band", "delta")))).alias("bands"), F.first("gain").alias("program_gain"), F.first("frames_used").alias("frames_used"))
    high = spec.where(F.col("hz") >= sizes.hf_low).groupBy(F.col("stem").alias("sig"), F.col("frame").alias("k"))
    high = high.agg(*(spectral.rms_db(F.avg(F.col(c) * F.col(c))).alias(c) for c in ("mag", "mb")))
    swing = lambda c, n: spectral.modulation(high.select("sig", "k", F.col(c).alias("x")), sr / sizes.hop).select("sig", F.col("period").alias(f"hf_period_{n}"), F.col("depth").alias(f"hf_depth_{n}"))
    contour = spectral.hf_envelope_correlation(spec, sizes.hf_low).select(F.col("stem").alias("sig"), F.col("corr").alias("hf_envelope_corr"))
    related = kernels.welch_coherence(arrays, sizes.coherence, sr, sizes.hf_low, min(sr / 2, sizes.hf_high)).withColumnRenamed("coherence", "hf_coherence")

    found = stored(pitch.onsets(arrays.select("sig", "x"), sr, sizes.n_fft, sizes.hop), "onsets")
    again = pitch.onsets(arrays.select("sig", F.col("y").alias("x")), sr, sizes.n_fft, sizes.hop)
    counts = found.select("sig", F.size("y").alias("onsets_a")).join(again.select("sig", F.size("y").alias("onsets_b")), "sig")
    spots = found.select("sig", F.explode("y").alias("o")).select("sig", F.col("o").cast("long").alias("o"))
    attack = report.transients(ab, spots, at(0.025), at(0.025) - at(0.020), at(0.030), (at(0.400), at(0.050)))
    curve = report.dynamics(ab, sizes.n_fft, sizes.hop)
    steps = [levels.max_step(ab.select("sig", F.col("i").alias("k"), F.col(c).alias("x"))).withColumnRenamed("step", f"step_{c}") for c in "ab"]

    info = []
    for s, n in ((a, "a"), (b, "b")):
        rows = s.select("sig", "ch", F.posexplode("x").alias("i", "x"))
        d = levels.describe(rows, kernels.block_power(s, sr, at(0.4), at(0.1)), kernels.block_power(s, sr, at(3.0), at(0.1)), sr)
        info.append(d.select("sig", *(F.col(c).alias(f"{c}_{n}") for c in ("n", "duration", "peak_db", "clipped", "lufs", "lra"))))
    out = info[0].join(info[1], "sig").join(offset.select("sig", ms("coarse").alias("coarse_ms"), ms("offset").alias("offset_ms"), F.col("score").alias("offset_score")), "sig", "left")
    for part in (times, fine, bands, swing("mag", "a"), swing("mb", "b"), contour, related, counts, attack, curve, *steps, stereo(a, "a"), stereo(b, "b")):
        out = out.join(part, "sig", "left")
    return out.withColumns({
        "duration_delta_ms": 1000 * (F.col("duration_b") - F.col("duration_a")), "clipped_in": F.col("clipped_a"), "clipped_out": F.col("clipped_b"),
        "slope_delta": F.col("slope_b") - F.col("slope_a"), "decay_delta": F.col("decay_b") - F.col("decay_a"),
        "onsets_delta_pct": 100 * (F.col("onsets_b") - F.col("onsets_a")) / F.nullif(F.col("onsets_a"), F.lit(0)),
        "side_mid_delta": F.when(F.greatest(-F.col("side_mid_a"), -F.col("side_mid_b")) < float("inf"), F.col("side_mid_b") - F.col("side_mid_a")).otherwise(F.lit(float("-inf"))),
        "channels_preserved": F.col("channels_a") == F.col("channels_b"), "hf_increase": F.greatest(F.col("hf_depth_b") - F.col("hf_depth_a"), F.lit(0.0)),
    })
