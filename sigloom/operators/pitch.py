"""Onsets from the flux of mel bands, chroma from a constant-Q transform, and the alignment of sequences of vectors."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from sigloom.operators.kernels import per_signal

#: Fixed values of the peak picker, in seconds: reach of the maximum and of the mean before and after, waiting time; and the margin over the mean.
MAX_BEFORE, MAX_AFTER, MEAN_BEFORE, MEAN_AFTER, WAIT, MARGIN = 0.03, 0.0, 0.10, 0.10, 0.03, 0.07
#: Lowest pitch in Hz (C1), octaves and bins an octave of the constant-Q transform.
LOWEST, OCTAVES, PER_OCTAVE = 32.70319566257483, 7, 36


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def framed(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, n_fft // 2), n_fft)[::hop]


@lru_cache(maxsize=8)
def mel_bank(sr: float, n_fft: int, bands: int) -> np.ndarray:
    """Triangles of equal area, evenly spaced in mel (linear to 1000 Hz, logarithmic above), as a matrix of bins by bands."""
    knee, step = 15.0, np.log(6.4) / 27
    hz = lambda m: np.where(m < knee, m * 200 / 3, 1000 * np.exp(step * (np.minimum(m, 200) - knee)))
    top = knee + np.log(sr / 2 / 1000) / step if sr > 2000 else sr / 2 * 3 / 200
    edges = hz(np.linspace(0, top, bands + 2))
    bins = np.arange(n_fft // 2 + 1)[:, None] * sr / n_fft
    rise, fall = (bins - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - bins) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)) * 2 / (edges[2:] - edges[:-2])


def flux(x: np.ndarray, sr: float, n_fft: int = 2048, hop: int = 512, bands: int = 128) -> np.ndarray:
    """Mean rise of the mel bands' levels from frame to frame, moved to where the frames' centres hear it; levels reach 80 dB down."""
    bank, frames, power = mel_bank(sr, n_fft, bands), framed(x, n_fft, hop), []
    for at in range(0, len(frames), 512):  # some frames at a time
        power.append(np.abs(np.fft.rfft(frames[at : at + 512] * hann(n_fft), axis=1)) ** 2 @ bank)
    level = 10 * np.log10(np.maximum(np.concatenate(power), 1e-10))
    level = np.maximum(level, level.max() - 80)
    rise = np.maximum(0, np.diff(level, axis=0)).mean(1)
    return np.concatenate((np.zeros(1 + n_fft // (2 * hop)), rise))[: len(level)]


def peaks(v: np.ndarray, rate: float) -> np.ndarray:
    """Frames that are the largest near by, at least MARGIN over the mean around them, and WAIT after the one before."""
    a, b, c, d = (int(round(s * rate)) for s in (MAX_BEFORE, MAX_AFTER, MEAN_BEFORE, MEAN_AFTER))
    window = lambda lo, hi, fill: np.lib.stride_tricks.sliding_window_view(np.pad(v, (lo, hi), constant_values=fill), lo + hi + 1)
    top = window(a, b, -np.inf).max(1)
    count = window(c, d, 0.0).sum(1) / np.lib.stride_tricks.sliding_window_view(np.pad(np.ones(len(v)), (c, d)), c + d + 1).sum(1)
    found = np.flatnonzero((v == top) & (v >= count + MARGIN) & (v > 0))
    kept, last = [], -np.inf
    for k in found.tolist():  # candidates only
        if k > last + int(round(WAIT * rate)):
            kept.append(k)
            last = k
    return np.array(kept, int)


def onset_samples(x: np.ndarray, sr: float, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    """Where events begin, in samples, by frames of ``hop``; none in signals shorter than a frame or without change."""
    if len(x) < n_fft:
        return np.zeros(0)
    v = flux(x, sr, n_fft, hop)
    v = v - v.min()
    return peaks(v / v.max(), sr / hop) * float(hop) if v.max() > 0 else np.zeros(0)


def onsets(signals: DataFrame, sr: float, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """(sig, y): the onsets of each signal (sig, x) as sample positions."""
    return per_signal(signals, lambda x: onset_samples(x, sr, n_fft, hop))


@lru_cache(maxsize=4)
def constant_q(sr: float) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """The length of a transform and, for each pitch bin below its end, the few bins of it that make it up: first bin and weights.

    A kernel is a windowed tone whose length falls with its pitch; of its spectrum only what isn't below a hundredth of its peak is kept.
    """
    q = 1 / (2 ** (1 / PER_OCTAVE) - 1)
    n = 1 << int(np.ceil(np.log2(q * sr / LOWEST)))
    kernels = []
    for k in range(OCTAVES * PER_OCTAVE):
        hz = LOWEST * 2 ** (k / PER_OCTAVE)
        if hz * 2 ** (1 / PER_OCTAVE) >= sr / 2:
            break
        size = int(np.ceil(q * sr / hz))
        tone = np.zeros(n, complex)
        start = (n - size) // 2
        tone[start : start + size] = hann(size) / size * np.exp(2j * np.pi * hz * (np.arange(size) - size / 2) / sr)
        spectrum = np.fft.fft(np.fft.ifftshift(tone))[: n // 2 + 1]
        large = np.flatnonzero(np.abs(spectrum) > 0.01 * np.abs(spectrum).max())
        kernels.append((int(large[0]), np.conj(spectrum[large[0] : large[-1] + 1]) / n))
    return n, kernels


def chroma_array(x: np.ndarray, sr: float, hop: int = 512) -> np.ndarray:
    """(frames, 12): the strength of each pitch class from C on, the strongest of a frame being 1; silence is 0."""
    if not len(x):
        return np.zeros((0, 12))
    n, kernels = constant_q(sr)
    frames, out = framed(x, n, hop), []
    for at in range(0, len(frames), 64):  # transforms are long
        spectrum = np.fft.rfft(np.fft.ifftshift(frames[at : at + 64], axes=1), axis=1)
        strength = np.stack([np.abs(spectrum[:, lo : lo + len(w)] @ w) for lo, w in kernels], 1)
        # A third of a semitone to either side belongs to its class.
        place = ((np.arange(len(kernels)) + 1) * 12 // PER_OCTAVE) % 12
        out.append(strength @ (place[:, None] == np.arange(12)))
    v = np.concatenate(out)
    top = v.max(1, keepdims=True)
    return np.divide(v, top, out=np.zeros_like(v), where=top > 1e-10)


def chroma(signals: DataFrame, sr: float, hop: int = 512) -> DataFrame:
    """(sig, y): twelve numbers a frame, one frame after the other, of each signal (sig, x)."""
    return per_signal(signals, lambda x: chroma_array(x, sr, hop).ravel())


def align_cost(a: np.ndarray, b: np.ndarray, band: int | None = None) -> float:
    """Cost of the best alignment of two sequences of vectors over the sum of their lengths; steps on both sides count twice.

    Cells are filled by anti-diagonals, two of which are kept. With a ``band`` only cells within so many places of the line between the ends
    count. An empty side gives nan, no way through the band infinity.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float("nan")
    before, last = np.full(n, np.inf), np.full(n, np.inf)  # by row: the anti-diagonals two and one before
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1), min(n, k + 1))
        if band is not None:
            i = i[np.abs(i * max(m - 1, 1) / max(n - 1, 1) - (k - i)) <= max(band, (m - 1) / max(n - 1, 1))]
        now = np.full(n, np.inf)
        if len(i):
            cost = np.sqrt(((a[i] - b[k - i]) ** 2).sum(1))
            up = np.where(i > 0, last[i - 1], np.inf)
            both = np.where(i > 0, before[i - 1], np.inf)
            now[i] = np.minimum(np.minimum(up, last[i]) + cost, both + 2 * cost)
            if not k:
                now[0] = cost[0]
        before, last = last, now
    return float(last[n - 1] / (n + m))


def chroma_distance(pairs: DataFrame, width: int = 12, band: int | None = None) -> DataFrame:
    """(sig, distance): alignment cost of two sequences of vectors (sig, x, y), each ``width`` numbers a place, one after the other."""

    def run(parts):
        import pandas as pd

        for part in parts:
            each = [align_cost(*(np.asarray(v, float).reshape(-1, width) for v in pair), band) for pair in zip(part.x, part.y, strict=True)]
            yield pd.DataFrame({"sig": part.sig, "distance": pd.Series(each, dtype=float)})

    return pairs.select("sig", "x", "y").mapInPandas(run, "sig long, distance double")
