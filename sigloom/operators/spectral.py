"""Spectra of short frames, and what is read off them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.numeric import EPS, clip, correlation, db, rms_db

#: The ten half-open bands of a report, in Hz.
BANDS = (
    ("20_100", 20, 100), ("100_250", 100, 250), ("250_500", 250, 500), ("500_1k", 500, 1000), ("1k_2_5k", 1000, 2500),
    ("2_5k_5k", 2500, 5000), ("5k_8k", 5000, 8000), ("8k_10k", 8000, 10000), ("10k_16k", 10000, 16000), ("16k_24k", 16000, 24000),
)


def dft(frames: DataFrame, n: int, sr: int, phase: bool = False, second: str | None = None, window=None) -> DataFrame:
    """(stem, frame, bin, hz, mag): magnitudes of arrays ``x`` of n samples, by FFT over Arrow batches; also ``phase``.

    ``second`` names another array of each row, whose magnitude comes as ``mb`` beside mag, so that two sides need no join.
    Frames of another length are left out.
    """
    columns = ["x", *([second] if second else [])]
    taper = np.ones(n) if window is None else np.asarray(window, float)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [batch.column("stem"), batch.column("frame")]
            for c in columns:
                flat = batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
                spec = np.fft.rfft(flat * taper, axis=1)
                sides = [np.abs(spec)] + ([np.arctan2(np.round(spec.imag, 9) + 0.0, spec.real)] if phase and c == "x" else [])
                offsets = np.arange(0, spec.size + 1, spec.shape[1], dtype=np.int32)
                out += [pa.ListArray.from_arrays(offsets, side.ravel()) for side in sides]
            yield pa.RecordBatch.from_arrays(out, names=["stem", "frame", "mag", *(["phase"] if phase else []), *(["mb"] if second else [])])

    ddl = "stem bigint, frame bigint, mag array<double>" + ", phase array<double>" * phase + ", mb array<double>" * bool(second)
    fits = frames.where(" and ".join(f"size({c}) = {n} and not exists({c}, v -> v is null)" for c in columns))
    whole = fits.select(F.col("stem").cast("long").alias("stem"), F.col("frame").cast("long").alias("frame"), *columns).mapInArrow(run, ddl)
    spread = whole.select("stem", "frame", F.posexplode(F.arrays_zip(*whole.columns[2:])).alias("bin", "v"))
    return spread.select("stem", "frame", F.col("bin").cast("long").alias("bin"), (F.col("bin") * sr / n).alias("hz"), *(F.col(f"v.{c}").alias(c) for c in whole.columns[2:]))


def stft(signals: DataFrame, n: int = 2048, hop: int = 512, second: str | None = None) -> DataFrame:
    """(stem, frame, x and ``second``): frames of arrays ``x`` of each signal (sig, x), centred: half a frame of zeros stands at both ends.

    Their spectrum is that of :func:`dft` with :func:`hann`.
    """
    columns = ["x", *([second] if second else [])]
    zeros = F.array_repeat(F.lit(0.0), n // 2)
    padded = signals.select("sig", *(F.concat(zeros, F.col(c), zeros).alias(c) for c in columns)).where(F.size("x") >= n)
    starts = padded.select("sig", *columns, F.explode(F.sequence(F.lit(0), F.expr(f"(size(x) - {n}) div {hop}"))).alias("frame"))
    part = lambda c: F.slice(c, F.col("frame") * hop + 1, F.lit(n)).alias(c)
    return starts.select(F.col("sig").alias("stem"), F.col("frame").cast("long").alias("frame"), *map(part, columns))


def hann(n: int) -> np.ndarray:
    """The periodic window of short-time spectra."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def percentile_spectrum(spec: DataFrame, q: float = 0.95) -> DataFrame:
    """(stem, bin, hz, amp, level): the q-th percentile over frames, exact, and its dB."""
    g = spec.groupBy("stem", "bin", "hz").agg(F.percentile("mag", F.lit(q)).alias("amp"))
    return g.withColumn("level", 20 * F.log10(F.col("amp") + F.lit(EPS)))


def spectral_cliff(p: DataFrame, width: int, floor_hz: float, drop: float) -> DataFrame:
    """(stem, cliff_hz): the last bin from which the level falls by ``drop`` over ``width`` bins; null without one."""
    d = p.withColumn("fall", F.col("level") - F.lead("level", width).over(Window.partitionBy("stem").orderBy("bin")))
    return d.groupBy("stem").agg(F.max(F.when((F.col("hz") >= floor_hz) & (F.col("fall") >= drop), F.col("hz"))).alias("cliff_hz"))


def energy_above(p: DataFrame, cutoff: float) -> DataFrame:
    """(stem, pct): share of the summed percentile amplitude from the cut-off on; 0 without any."""
    part = F.sum(F.when(F.col("hz") >= cutoff, F.col("amp")).otherwise(0.0))
    return p.groupBy("stem").agg(F.coalesce(100 * part / F.nullif(F.sum("amp"), F.lit(0.0)), F.lit(0.0)).alias("pct"))


def features(spec: DataFrame) -> DataFrame:
    """Centroid, 85 % and 99 % roll-off, flatness and its risk of each frame."""
    order = Window.partitionBy("stem", "frame").orderBy("bin")
    s = spec.withColumn("run", F.sum("mag").over(order)).withColumn("all", F.sum("mag").over(Window.partitionBy("stem", "frame")))
    power = F.greatest(F.col("mag") * F.col("mag"), F.lit(1e-10))
    g = s.groupBy("stem", "frame").agg(
        (F.sum(F.col("hz") * F.col("mag")) / F.nullif(F.sum("mag"), F.lit(0.0))).alias("centroid"),
        F.min(F.when(F.col("run") >= 0.85 * F.col("all") - 1e-9, F.col("hz"))).alias("rolloff85"), F.min(F.when(F.col("run") >= 0.99 * F.col("all") - 1e-9, F.col("hz"))).alias("rolloff99"),
        (F.exp(F.avg(F.log(power))) / F.avg(power)).alias("flatness"),
    )
    return g.withColumn("risk", clip((F.col("flatness") - 0.15) / 0.20, 0.0, 1.0))


def with_bands(spec: DataFrame, nyquist: float) -> DataFrame:
    """Adds the band of each bin: low <= hz < min(high, nyquist); bins in no band are dropped. The table is a literal."""
    name = None
    for label, low, high in BANDS:
        if low < nyquist:
            inside = (F.col("hz") >= low) & (F.col("hz") < min(high, nyquist))
            name = F.when(inside, label) if name is None else name.when(inside, label)
    return spec.withColumn("band", name).where("band is not null")


def band_delta(both: DataFrame, nyquist: float) -> DataFrame:
    """(stem, band, delta, gain, frames_used): change of each band from magnitude mag to mb, less the programme gain.

    Only frames at or above the 40th percentile of a's level count, or all if fewer than four do.
    """
    both = both.withColumns({"pa": F.col("mag") * F.col("mag"), "pb": F.col("mb") * F.col("mb")})
    level = lambda c: 10 * F.log10(F.sum(c) + F.lit(EPS))
    f = both.groupBy("stem", "frame").agg(level("pa").alias("da"), level("pb").alias("db"))
    gate = f.groupBy("stem").agg(F.percentile("da", F.lit(0.4)).alias("gate"))
    f = f.join(gate, "stem").withColumn("loud", F.col("da") >= F.col("gate"))
    f = f.withColumn("n", F.sum(F.col("loud").cast("int")).over(Window.partitionBy("stem"))).where("loud or n < 4")
    gain = f.groupBy("stem").agg(F.median(F.col("db") - F.col("da")).alias("gain"), F.count("*").alias("frames_used"))
    bands = with_bands(both, nyquist).groupBy("stem", "frame", "band").agg(level("pa").alias("ba"), level("pb").alias("bb"))
    d = bands.join(f.select("stem", "frame"), ["stem", "frame"]).groupBy("stem", "band").agg(F.median(F.col("bb") - F.col("ba")).alias("d"), F.count("*").alias("k")).where("k >= 4")
    return d.join(gain, "stem").select("stem", "band", (F.col("d") - F.col("gain")).alias("delta"), "gain", "frames_used")


#: Fewer frames say nothing about an envelope.
ENVELOPE_FRAMES = 16


def hf_envelope_correlation(both: DataFrame, cutoff: float) -> DataFrame:
    """(stem, corr, n_frames): level of mb above the cut-off against the whole level of mag, frame by frame.

    No bin from the cut-off on gives no row; with fewer than ENVELOPE_FRAMES frames, or a level that doesn't vary, corr is null.
    """
    high = F.when(F.col("hz") >= cutoff, F.col("mb") * F.col("mb"))
    f = both.groupBy("stem", "frame").agg(rms_db(F.avg(F.col("mag") * F.col("mag"))).alias("u"), rms_db(F.avg(high)).alias("v")).where("v is not null")
    g = f.groupBy("stem").agg(correlation("u", "v").alias("corr"), F.count("*").alias("n_frames"))
    return g.select("stem", F.when(F.col("n_frames") >= ENVELOPE_FRAMES, F.col("corr")).alias("corr"), "n_frames")


#: Periods in seconds of a swing that counts, and the shortest signal in seconds and frames.
SLOWEST, FASTEST, SWING_SECONDS, SWING_FRAMES = 30.0, 2.0, 4.0, 16


def modulation(levels: DataFrame, rate: float) -> DataFrame:
    """(sig, period, depth): the strongest swing of 2 to 30 seconds in all levels (sig, k, x), ``rate`` a second.

    The mean goes, a Hann window applies, and a parabola through the peak gives the period between bins. Signals under 4
    seconds or 16 levels, or without such a period, have zeros. A signal's levels (some dozens a second) are one group.
    """

    def run(parts):
        import pandas as pd

        for part in parts:
            found = [swing(np.asarray(x, float), rate) for x in part.x]
            yield pd.DataFrame({"sig": part.sig, "period": [f[0] for f in found], "depth": [f[1] for f in found]})

    rows = levels.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v"))
    return rows.select(F.col("sig").cast("long").alias("sig"), F.col("v.x").cast("array<double>").alias("x")).mapInPandas(run, "sig long, period double, depth double")


def swing(x: np.ndarray, rate: float) -> tuple[float, float]:
    n = len(x)
    if n < SWING_FRAMES or n / rate < SWING_SECONDS:
        return 0.0, 0.0
    size = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(n)))
    bins = np.arange(1, len(size))
    bins = bins[(n / rate / bins >= FASTEST) & (n / rate / bins <= SLOWEST)]
    if not len(bins):
        return 0.0, 0.0
    top = int(bins[np.argmax(np.round(size[bins], 9))])
    shift = 0.0
    if top + 1 < len(size):
        low, mid, high = size[top - 1 : top + 2]
        bend = low - 2 * mid + high
        shift = float(np.clip((low - high) / (2 * bend), -0.5, 0.5)) if bend else 0.0
    return n / rate / (top + shift), float(4 * size[top] / n)


def stereo_metrics(lr: DataFrame) -> DataFrame:
    """(pair, side_mid_db, corr): level of side over mid, and the channels' correlation, 1 where a channel is constant."""
    mid, side = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2
    g = lr.groupBy("pair").agg(F.sqrt(F.avg(mid * mid)).alias("m"), F.sqrt(F.avg(side * side)).alias("s"), F.coalesce(correlation("l", "r"), F.lit(1.0)).alias("corr"))
    return g.select("pair", F.when((F.col("s") > 0) & (F.col("m") > 0), db(F.col("s")) - db(F.col("m"))).otherwise(F.lit(float("-inf"))).alias("side_mid_db"), "corr")


def to_mid_side(lr: DataFrame) -> DataFrame:
    """(pair, i, mid, side) of (pair, i, l, r). A row without both channels fails: only stereo has a middle and a side."""
    both = F.when(F.col("l").isNull() | F.col("r").isNull(), F.raise_error(F.lit("mid and side need two channels")).cast("double"))
    return lr.select("pair", "i", both.otherwise((F.col("l") + F.col("r")) / 2).alias("mid"), ((F.col("l") - F.col("r")) / 2).alias("side"))


def from_mid_side(ms: DataFrame) -> DataFrame:
    return ms.select("pair", "i", (F.col("mid") + F.col("side")).alias("l"), (F.col("mid") - F.col("side")).alias("r"))
