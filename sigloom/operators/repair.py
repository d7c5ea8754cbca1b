"""Repair of degraded stretches: found by risk, played again from donor notes, spliced in, and kept only if the risk fell.

Stems are rows (sig, ch, sr, x array) at rates of their own. Everything is measured and rendered on the mean of the channels at one rate;
what comes back to a stem is only the change, at the stem's rate and in all its channels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.numeric import clip
from sigloom.operators import events, kernels, layout, timing
from sigloom.sources.interim import stored

#: The rate of the analysis, its frames, the shortest donor and note, the fades, and flatness of no and of full risk.
RATE, N_FFT, HOP = 22_050, 2048, 512
LEAST_SAMPLES, LEAST_SECONDS, FADE_SECONDS = 512, 0.05, 0.05
FLAT_LOW, FLAT_HIGH = 0.15, 0.35


def at_rate(signals: DataFrame, source: str, target: str) -> DataFrame:
    """(sig, x): arrays converted from the rate in one column to that in another."""

    def run(parts):
        import pandas as pd

        for part in parts:
            made = [kernels.resample_array(np.asarray(x, float), int(a), int(b)) for x, a, b in zip(part.x, part.a, part.b, strict=True)]
            yield pd.DataFrame({"sig": part.sig, "x": made})

    return signals.select("sig", "x", F.col(source).alias("a"), F.col(target).alias("b")).mapInPandas(run, "sig long, x array<double>")


def analysis_signals(stems: DataFrame, rate: int = RATE) -> DataFrame:
    """(sig, x): the mean of the channels of each stem, as long as the shortest one, at the analysis rate."""
    add = lambda a, b: F.zip_with(a, b, lambda u, v: u + v)
    both = stems.groupBy("sig").agg(F.collect_list("x").alias("v"), F.max("sr").alias("sr"))
    total = F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.get("v", F.lit(0)), lambda a, b: add(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b)))))
    mono = both.select("sig", "sr", F.transform(total, lambda x: x / F.size("v")).alias("x"), F.lit(rate).alias("rate"))
    return at_rate(mono, "sr", "rate")


def risk_frames(signals: DataFrame, n_fft: int = N_FFT, hop: int = HOP) -> DataFrame:
    """(sig, k, x): how flat each centred frame's spectrum is, from 0 (a tone) to 1 (noise)."""

    def run(parts):
        import pandas as pd

        for part in parts:
            out = []
            for sig, x in zip(part.sig, part.x, strict=True):
                x = np.pad(np.asarray(x, float), n_fft // 2)
                frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
                for at in range(0, len(frames), 256):  # some frames at a time: memory is that of the samples
                    power = np.maximum(np.abs(np.fft.rfft(frames[at : at + 256] * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2, 1e-10)
                    flat = np.exp(np.log(power).mean(1)) / power.mean(1)
                    out.append(pd.DataFrame({"sig": sig, "k": np.arange(at, at + len(flat)), "x": np.clip((flat - FLAT_LOW) / (FLAT_HIGH - FLAT_LOW), 0, 1)}))
            yield pd.concat(out) if out else pd.DataFrame({"sig": [], "k": [], "x": []})

    return signals.select("sig", "x").mapInPandas(run, "sig long, k long, x double")


def played(targets: DataFrame, library: DataFrame, signals: DataFrame, windows: DataFrame, rate: int = RATE) -> DataFrame:
    """(sig, k, place, y): for each target its donor's samples, shifted to its pitch and stretched to its length, and where in the window they begin.

    targets and library (sig, k, onset, dur, pitch), windows (sig, start, first, size). A donor of fewer than LEAST_SAMPLES is left out.
    """
    long = lambda c: F.greatest(F.col(c), F.lit(LEAST_SECONDS))
    found = events.match_donors(targets, library)
    donors = library.select("sig", F.col("k").alias("donor_k"), F.expr(f"int(onset * {rate})").alias("a"), ((F.col("onset") + long("dur")) * rate).cast("int").alias("b"))
    spots = found.join(donors, ["sig", "donor_k"]).join(windows, "sig").select(
        "sig", "k", "shift", long("dur").alias("dur"), ((F.col("onset") - F.col("start")) * rate).cast("int").alias("place"), F.greatest("a", F.lit(0)).alias("a"), "b", "size"
    )
    clips = spots.join(signals, "sig").select("sig", "k", "shift", "dur", "place", F.slice("x", F.col("a") + 1, F.greatest(F.least("b", F.size("x")) - F.col("a"), F.lit(0))).alias("x"), "size")

    def run(parts):
        import pandas as pd

        for part in parts:
            made = [reshaped(np.asarray(x, float), shift, dur, rate)[: max(0, size - place)] for x, shift, dur, size, place in zip(part.x, part["shift"], part.dur, part["size"], part.place, strict=True)]
            yield pd.DataFrame({"sig": part.sig, "k": part.k, "place": part.place, "y": made})

    return clips.where((F.size("x") >= LEAST_SAMPLES) & (F.col("place") < F.col("size"))).mapInPandas(run, "sig long, k long, place long, y array<double>")


def reshaped(x: np.ndarray, semitones: float, seconds: float, rate: int) -> np.ndarray:
    """A donor at another pitch and length; frames are no longer than the donor."""
    n_fft = min(N_FFT, 1 << (len(x).bit_length() - 1))
    y = kernels.shifted(x, semitones, n_fft, n_fft // 4, LEAST_SAMPLES)
    return kernels.stretched(y, len(y) / rate / seconds, n_fft, n_fft // 4)


def rendered(pieces: DataFrame, windows: DataFrame) -> DataFrame:
    """(sig, j, p): the pieces of each window (sig, size) summed by position, silence elsewhere; a window that peaks over 1 is brought to 0.95."""
    sums = pieces.select("sig", "place", F.posexplode("y").alias("o", "p")).groupBy("sig", (F.col("place") + F.col("o")).alias("j")).agg(F.sum("p").alias("p"))
    peaks = sums.groupBy("sig").agg(F.max(F.abs("p")).alias("peak"))
    grid = windows.where("size > 0").join(peaks, "sig", "left").select("sig", "peak", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size").cast("long") - 1)).alias("j"))
    p = F.coalesce("p", F.lit(0.0)) * F.when(F.col("peak") > 1, 0.95 / F.col("peak")).otherwise(1.0)
    return grid.join(sums, ["sig", "j"], "left").select("sig", "j", p.alias("p"))


def enhance(stems: DataFrame, notes: DataFrame, repaired: DataFrame, rate: int = RATE, n_fft: int = N_FFT, hop: int = HOP) -> DataFrame:
    """(sig, ch, sr, x, start, end, before, after, status): stems with their riskiest stretch played again from donor notes.

    stems (sig, ch, sr, x array); notes and repaired (sig, k, onset, dur, pitch in semitones): what is heard, and what should be inside the
    stretch. status: unflagged (no stretch), no donors (no note outside it), not better (the mean risk inside didn't fall) or
    repaired; samples are unchanged unless it is repaired. ``before`` and ``after`` are the mean risks inside.
    """
    dt = hop / rate
    mono = stored(analysis_signals(stems, rate), "analysis")
    risk = stored(risk_frames(mono, n_fft, hop), "risk")
    region = timing.risk_region(risk, dt).where("start is not null")
    first = F.greatest(F.lit(0), F.expr(f"int(start * {rate})"))
    size = F.greatest(F.lit(0), F.least(((F.col("end") - F.col("start")) * rate).cast("int"), F.size("x") - first))
    region = stored(region.join(mono, "sig").select("sig", "start", "end", first.alias("first"), size.alias("size")), "regions")
    spans = region.select("sig", F.col("start").alias("from"), F.col("end").alias("to"))
    inside = (F.col("onset") >= F.col("from")) & (F.col("onset") < F.col("to"))
    library = notes.join(spans, "sig").where(~inside).drop("from", "to")
    targets = repaired.join(spans, "sig").where(inside).select("sig", "k", "onset", "dur", "pitch")
    able = region.join(library.select("sig").distinct(), "sig", "left_semi")
    patch = rendered(played(targets, library, mono, able, rate), able)
    old = mono.join(able, "sig").select("sig", F.posexplode(F.slice("x", F.col("first") + 1, F.col("size"))).alias("i", "x")).withColumn("i", F.col("i").cast("long"))
    mixed = events.crossfade(old, patch, 0, 1 << 40, int(FADE_SECONDS * rate)).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("i", "y"))).alias("m"))
    base = mono.join(able, "sig").join(mixed, "sig")
    new = stored(base.select("sig", "first", F.concat(F.slice("x", F.lit(1), F.col("first")), F.col("m.y"), F.slice("x", F.col("first") + F.col("size") + 1, F.size("x"))).alias("x")), "candidates")

    limits = region.select("sig", "start", "end")
    verdict = layout.keep_if_better(layout.masked_mean(risk, limits, dt, "x"), layout.masked_mean(risk_frames(new, n_fft, hop), limits, dt, "x"))
    verdict = stored(verdict, "verdicts")
    change = new.join(mono.withColumnRenamed("x", "was"), "sig").join(verdict.where("kept"), "sig", "left_semi").select("sig", F.zip_with("x", "was", lambda a, b: a - b).alias("x"))
    rates = stems.groupBy("sig").agg(F.max("sr").alias("sr"))
    delta = at_rate(change.join(rates, "sig").withColumn("rate", F.lit(rate)), "rate", "sr").withColumnRenamed("x", "d")
    out = stems.join(delta, "sig", "left").join(region.select("sig", "start", "end"), "sig", "left").join(verdict, "sig", "left").join(able.select("sig", F.lit(True).alias("able")), "sig", "left")
    moved = F.zip_with("x", F.slice("d", F.lit(1), F.size("x")), lambda v, e: clip(v + F.coalesce(e, F.lit(0.0)), -1.0, 1.0))
    status = F.when(F.col("start").isNull(), "unflagged").when(F.col("able").isNull(), "no donors").when(F.col("kept"), "repaired").otherwise("not better")
    return out.select("sig", "ch", "sr", F.when(F.col("d").isNotNull(), moved).otherwise(F.col("x")).alias("x"), "start", "end", "before", F.when(F.col("able"), F.col("after")).alias("after"), status.alias("status"))
