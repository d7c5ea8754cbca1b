"""Operators with sequential state or transforms, as Arrow-batched Python over one signal at a time.

Signals come as rows (sig, x array<double>). Resampling, warping and onset strength follow the usual textbook forms;
they agree with other implementations to a tolerance, not bit by bit.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.timing import window_scores


def per_signal(signals: DataFrame, function, ddl: str = "sig long, y array<double>") -> DataFrame:
    """``function(x) -> y`` (or a tuple for several columns after sig) over each signal's array."""

    def run(parts):
        import pandas as pd

        names = [c.split()[0] for c in ddl.split(", ")]
        for part in parts:
            rows = []
            for sig, x in zip(part.sig, part.x, strict=True):
                y = function(np.asarray(x if x is not None else [], float))
                rows.append((sig, *(y if isinstance(y, tuple) else (y.tolist(),))))
            yield pd.DataFrame(rows, columns=names)

    return signals.select("sig", "x").mapInPandas(run, ddl)


@lru_cache(maxsize=16)
def responses(a: tuple, block: int) -> tuple[np.ndarray, np.ndarray]:
    """How the two past outputs of a section go on by themselves over a block, and the response to each of its samples."""
    free, rest = np.zeros((block, 2)), np.zeros(block)
    for k in range(block):
        past = lambda v, n: v[k - n] if k >= n else 0.0  # noqa: B023, E731
        rest[k] = (k == 0) - a[0] * past(rest, 1) - a[1] * past(rest, 2)
        for c, (y1, y2) in enumerate(((1.0, 0.0), (0.0, 1.0))):
            one = free[k - 1, c] if k else y1
            two = free[k - 2, c] if k > 1 else (y1 if k else y2)
            free[k, c] = -a[0] * one - a[1] * two
    return free, np.array([[rest[i - j] if i >= j else 0.0 for j in range(block)] for i in range(block)])


def biquad(x: np.ndarray, b: tuple, a: tuple, block: int = 128) -> np.ndarray:
    """A second-order section over a whole signal, block by block: a block is its response at rest plus that to the state before it."""
    free, matrix = responses(tuple(map(float, a)), block)
    feed = np.convolve(x, b)[: len(x)]
    pieces = np.pad(feed, (0, -len(x) % block)).reshape(-1, block) @ matrix.T
    y1 = y2 = 0.0
    for row in pieces:
        row += free[:, 0] * y1 + free[:, 1] * y2
        y1, y2 = row[-1], row[-2]
    return pieces.ravel()[: len(x)]


def k_weighting(sr: float) -> list[tuple[tuple, tuple]]:
    """The two sections of loudness measurement as (b, a1 and a2): a high shelf and a high-pass of the audio EQ cookbook.

    Fixed values: the corner frequencies, qualities and gain of the standard.
    """
    turn, q = 2 * np.pi * 1681.974450955533 / sr, 0.7071752369554196
    amp, c = 10 ** (3.999843853973347 / 40), np.cos(turn)
    swell = np.sqrt(amp) * np.sin(turn) / q
    up, down = amp + 1 + (amp - 1) * c, amp + 1 - (amp - 1) * c
    shelf = np.array([amp * (up + swell), -2 * amp * (amp - 1 + (amp + 1) * c), amp * (up - swell)]) / (down + swell)
    shelf_a = np.array([2 * (amp - 1 - (amp + 1) * c), down - swell]) / (down + swell)
    turn, q = 2 * np.pi * 38.13547087602444 / sr, 0.5003270373238773
    c, width = np.cos(turn), np.sin(turn) / (2 * q)
    cut = np.array([(1 + c) / 2, -1 - c, (1 + c) / 2]) / (1 + width)
    return [(tuple(shelf), tuple(shelf_a)), (tuple(cut), tuple(np.array([-2 * c, 1 - width]) / (1 + width)))]


def k_weight(signals: DataFrame, sr: float) -> DataFrame:
    parts = k_weighting(sr)

    def run(x):
        for b, a in parts:
            x = biquad(x, b, a) if len(x) else x
        return x

    return per_signal(signals, run)


def block_power(channels: DataFrame, sr: float, block: int, hop: int) -> DataFrame:
    """(sig, frame, power): mean squares of K-weighted blocks, summed over the channels; channels (sig, ch, x array).

    All blocks that fit count, the one that ends with the last sample too; a signal shorter than one has no row.
    """
    parts = k_weighting(sr)

    def run(rows):
        import pandas as pd

        for part in rows:
            out = []
            for sig, x in zip(part.sig, part.x, strict=True):
                x = np.asarray(x, float)
                for b, a in parts:
                    x = biquad(x, b, a) if len(x) else x
                sums = np.concatenate(([0.0], np.cumsum(x * x)))
                starts = np.arange(0, len(x) - block + 1, hop)
                out.append(pd.DataFrame({"sig": sig, "frame": np.arange(len(starts)), "power": (sums[starts + block] - sums[starts]) / block}))
            yield pd.concat(out) if out else pd.DataFrame({"sig": [], "frame": [], "power": []})

    each = channels.select("sig", "x").mapInPandas(run, "sig long, frame long, power double")
    return each.groupBy("sig", "frame").agg(F.sum("power").alias("power"))


def resample_array(x: np.ndarray, source: int, target: int, zeros: int = 16) -> np.ndarray:
    """Windowed-sinc resampling; the same array where the rates are equal."""
    if source == target or not len(x):
        return x
    return resample_range(lambda lo, hi: x[None, lo:hi], len(x), 0, int(round(len(x) * target / source)), source, target, zeros)[0]


def resample_range(read, n: int, lo: int, hi: int, source: int, target: int, zeros: int = 16) -> np.ndarray:
    """Outputs lo to hi, a row a channel, of a signal of n samples, of which ``read(a, b)`` gives those from a to b.

    Only the samples that these outputs hear are read, so blocks of a long signal are made one by one, and
    equal those of the whole. With the ratio in lowest terms there are as many phases as outputs in a cycle; each phase's taps
    are worked out once.
    """
    shared = math.gcd(source, target)
    up, down = target // shared, source // shared
    scale = min(1.0, target / source)
    reach = int(np.ceil(zeros / scale))
    offsets = np.arange(-reach, reach + 1)
    first, end = lo * down // up - reach, max(lo, hi - 1) * down // up + reach + 1
    x = np.asarray(read(max(0, first), min(n, end)), float)
    x = np.pad(x, ((0, 0), (max(0, -first), max(0, end - n) + 1)))
    windows = np.lib.stride_tricks.sliding_window_view(x, len(offsets), axis=1)
    out = np.zeros((len(x), max(0, hi - lo)))
    for phase in range(min(up, hi - lo)):
        m = np.arange(lo + phase, hi, up)  # one phase, as many samples apart each time
        at = m[0] * down
        d = (offsets - at % up / up) * scale
        taps = np.sinc(d) * np.where(np.abs(d) < zeros, np.cos(np.pi * d / (2 * zeros)) ** 2, 0) * scale
        out[:, phase::up] = windows[:, at // up - reach - first :: down][:, : len(m)] @ taps
    return out


def resample(signals: DataFrame, source: int, target: int) -> DataFrame:
    return per_signal(signals, lambda x: resample_array(x, source, target))


def stft(x: np.ndarray, n: int, hop: int) -> np.ndarray:
    pad = np.pad(x, n // 2)
    count = 1 + (len(pad) - n) // hop
    frames = np.lib.stride_tricks.sliding_window_view(pad, n)[::hop][:count]
    return np.fft.rfft(frames * np.hanning(n + 1)[:-1], axis=1)


def phase_warp_array(x: np.ndarray, src: np.ndarray, dst: np.ndarray, n_fft: int = 32, hop: int = 8) -> np.ndarray:
    """Reads a signal through a warp map with a phase vocoder: magnitudes between frames, phases accumulated."""
    if np.array_equal(src, dst) or len(x) < n_fft:
        return x
    length = int(round(dst[-1]))
    s = stft(x, n_fft, hop)
    count = length // hop + 2
    at = np.interp(np.arange(count) * hop, dst, src) / hop
    k = np.clip(np.floor(at).astype(int), 0, len(s) - 1)
    up, share = np.minimum(k + 1, len(s) - 1), (at - np.floor(at))[:, None]
    mag = (1 - share) * np.abs(s[k]) + share * np.abs(s[up])
    expected = 2 * np.pi * hop * np.arange(s.shape[1]) / n_fft
    step = np.angle(s[up]) - np.angle(s[k]) - expected
    step += expected - 2 * np.pi * np.rint(step / (2 * np.pi))
    phase = np.angle(s[0]) + np.concatenate((np.zeros((1, s.shape[1])), np.cumsum(step, 0)[:-1]))
    out, weight, win = np.zeros(count * hop + n_fft), np.zeros(count * hop + n_fft), np.hanning(n_fft + 1)[:-1]
    frames = np.fft.irfft(mag * np.exp(1j * phase), n_fft, axis=1) * win
    for i, f in enumerate(frames):
        out[i * hop : i * hop + n_fft] += f
        weight[i * hop : i * hop + n_fft] += win * win
    return (out / np.maximum(weight, 1e-6))[n_fft // 2 : n_fft // 2 + length]


def phase_warp(signals: DataFrame, src: list[float] | None = None, dst: list[float] | None = None, n_fft: int = 32, hop: int = 8) -> DataFrame:
    """(sig, y): signals (sig, x) read through one map, or through their own where they have arrays src and dst."""
    if src is not None:
        a, b = np.array(src), np.array(dst)
        return per_signal(signals, lambda x: phase_warp_array(x, a, b, n_fft, hop))

    def run(parts):
        import pandas as pd

        for part in parts:
            warped = [phase_warp_array(*(np.asarray(v, float) for v in row), n_fft, hop).tolist() for row in zip(part.x, part.src, part.dst, strict=True)]
            yield pd.DataFrame({"sig": part.sig, "y": warped})

    return signals.select("sig", "x", "src", "dst").mapInPandas(run, "sig long, y array<double>")


def stretched(x: np.ndarray, rate: float, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    """Duration divided by ``rate``, clipped to 0.25 to 4, pitch unchanged; shorter than a frame: as it is."""
    rate = min(4.0, max(0.25, rate))
    return phase_warp_array(x, np.array([0.0, len(x)]), np.array([0.0, max(1.0, len(x) / rate)]), n_fft, hop)


def shifted(x: np.ndarray, semitones: float, n_fft: int = 2048, hop: int = 512, least: int = 512) -> np.ndarray:
    """Pitch changed, duration unchanged: stretched, then resampled back; arrays under ``least`` samples or a frame stay."""
    if len(x) < max(least, n_fft) or not semitones:
        return x
    factor = 2 ** (semitones / 12)
    y = phase_warp_array(x, np.array([0.0, len(x)]), np.array([0.0, len(x) * factor]), n_fft, hop)
    y = resample_array(y, int(round(10000 * factor)), 10000)
    return np.pad(y, (0, max(0, len(x) - len(y))))[: len(x)]


def time_stretch(signals: DataFrame, rate: float, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    return per_signal(signals, lambda x: stretched(x, rate, n_fft, hop))


def pitch_shift(signals: DataFrame, semitones: float, n_fft: int = 2048, hop: int = 512, least: int = 512) -> DataFrame:
    return per_signal(signals, lambda x: shifted(x, semitones, n_fft, hop, least))


def onsets(signals: DataFrame, hop: int, n_fft: int = 32, delta: float = 0.07) -> DataFrame:
    """(sig, y): samples at which the positive spectral flux peaks over its local mean."""

    def run(x):
        if len(x) < n_fft:
            return np.zeros(0)
        flux = np.maximum(np.diff(np.log1p(np.abs(stft(x, n_fft, hop))), axis=0), 0).mean(1)
        flux = flux / (flux.max() or 1.0)
        near = np.array([flux[max(0, i - 3) : i + 4].mean() for i in range(len(flux))])
        top = [i for i in range(len(flux)) if flux[i] == flux[max(0, i - 3) : i + 4].max() and flux[i] > near[i] + delta]
        return (np.array(top, float) + 1) * hop

    return per_signal(signals, run)


def coherence(pairs: DataFrame, n: int, low: int) -> DataFrame:
    """(sig, coherence): mean magnitude-squared coherence of (sig, frame, x, y) frames from bin ``low`` on."""

    def run(pdf):
        import pandas as pd

        win = np.hanning(n + 1)[:-1]
        x, y = (np.fft.rfft((v - v.mean(1, keepdims=True)) * win, axis=1) for v in (np.stack(pdf.x), np.stack(pdf.y)))
        c = np.abs((x * y.conj()).sum(0)) ** 2 / np.maximum((np.abs(x) ** 2).sum(0) * (np.abs(y) ** 2).sum(0), 1e-30)
        return pd.DataFrame({"sig": [int(pdf.sig.iloc[0])], "coherence": [float(c[low:].mean())]})

    return pairs.groupBy("sig").applyInPandas(run, "sig long, coherence double")


def welch_coherence(pairs: DataFrame, n: int, sr: float, low: float, high: float) -> DataFrame:
    """(sig, coherence): mean magnitude-squared coherence of (sig, x, y) arrays from ``low`` to ``high`` Hz.

    Frames of n samples overlap by half, each without its mean and under a periodic Hann window; null with n samples or fewer,
    without a bin in the range or with silence on a side. Bins that one side is silent in don't count.
    """
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    hz = np.arange(n // 2 + 1) * sr / n
    inside = (hz >= low) & (hz <= high)

    def one(x, y):
        x, y = np.asarray(x, float), np.asarray(y, float)
        if len(x) <= n or not inside.any():
            return None
        xx, yy, xy = np.zeros(len(hz)), np.zeros(len(hz)), np.zeros(len(hz), complex)
        for at in range(0, len(x) - n + 1, n // 2):  # a frame at a time, so that memory is that of one frame
            u, v = (np.fft.rfft((s[at : at + n] - s[at : at + n].mean()) * win) for s in (x, y))
            xx, yy, xy = xx + np.abs(u) ** 2, yy + np.abs(v) ** 2, xy + np.conj(u) * v
        power = (xx * yy)[inside]
        known = power > 0
        return float((np.abs(xy[inside][known]) ** 2 / power[known]).mean()) if known.any() else None

    def run(parts):
        import pandas as pd

        for part in parts:
            yield pd.DataFrame({"sig": part.sig, "coherence": pd.Series([one(x, y) for x, y in zip(part.x, part.y, strict=True)], dtype=float)})

    return pairs.select("sig", "x", "y").mapInPandas(run, "sig long, coherence double")


def track_offsets(ab: DataFrame, window: int, hop: int, search: int, overall: str | None = None) -> DataFrame:
    """(sig, w, lag, score): local offsets of b against a, each window searched around the one before; ab (sig, i, a, b).

    The first window searches as far as the overall offset (a column, 0 without) and ``search`` beyond, the later ones to
    ``search`` either way. A window whose offset is more than ``search`` from the one before is lost and leaves the state as it
    is; so drift may add up to any size. Silent windows, and those without room to move, are skipped. A null of b is a 0.
    The state is one number per signal, so each signal is folded in order.
    """
    data = ab.select("sig", "i", "a", "b", (F.col(overall) if overall else F.lit(0)).alias("o"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("i")
        a, b = pdf.a.to_numpy(float), pdf.b.fillna(0.0).to_numpy(float)
        found = [(int(pdf.sig.iloc[0]), *row) for row in tracked(a[~np.isnan(a)], b, window, hop, search, abs(int(pdf.o.iloc[0])))]
        return pd.DataFrame(found, columns=["sig", "w", "lag", "score"])

    return data.groupBy("sig").applyInPandas(run, "sig long, w long, lag long, score double")


def tracked(a: np.ndarray, b: np.ndarray, window: int, hop: int, search: int, overall: int):
    running = None
    for w, at in enumerate(range(0, len(a) - window, hop)):
        x = a[at : at + window]
        if np.sqrt(np.mean(x * x)) < 1e-5:
            continue
        centre, radius = (at, max(search, overall + search)) if running is None else (at + running, search)
        low = max(0, centre - radius)
        wide = b[low : max(low, min(len(b), centre + window + radius))]
        if len(wide) <= window:
            continue
        scores = window_scores(x, wide)
        best = int(np.argmax(np.round(scores, 9)))
        lag = low + best - at
        if running is not None and abs(lag - running) > search:
            continue
        running = lag
        yield w, lag, float(scores[best])


def apply_model(signals: DataFrame, load, ddl: str = "sig long, y array<double>") -> DataFrame:
    """A hook for pretrained models: ``load()`` runs once per worker and returns ``f(x) -> y``.

    A call that fails gives an empty result for its signal instead of ending the run.
    """

    def run(parts):
        import pandas as pd

        model = load()
        for part in parts:
            out = []
            for x in part.x:
                try:
                    out.append(np.asarray(model(np.asarray(x, float))).tolist())
                except RuntimeError:
                    out.append([])
            yield pd.DataFrame({"sig": part.sig, "y": out})

    return signals.select("sig", F.col("x")).mapInPandas(run, ddl)
