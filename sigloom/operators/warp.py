"""Reading stems through a warp map: a phase vocoder that keeps the channels of a stem together, spread over blocks.

The rotation of the bins comes from the mean of the channels and turns every channel alike, so what lies between left and
right stays. Each bin turns with the nearest spectral peak. Source positions are those of the monotone cubic through the anchors.

The accumulated phase is a sum over output frames. So blocks of frames add up their own advance first, the sums are carried
from block to block, and then every block is synthesised by itself from the source samples that its frames read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import timing
from sigloom.operators.blocks import SIZE

#: Frames of a block.
FRAMES = 256


def cubic(anchors: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The cubic through (dst, src) with given slopes, at any positions; the outer pieces go on beyond the ends."""
    dst, src, slope = anchors
    k = np.clip(np.searchsorted(dst, at, "right") - 1, 0, len(dst) - 2)
    h, rise = dst[k + 1] - dst[k], src[k + 1] - src[k]
    t = (at - dst[k]) / h
    return src[k] + t * rise + t * (1 - t) * (h * ((1 - t) * slope[k] - t * slope[k + 1]) + (2 * t - 1) * rise)


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def wrapped(angle: np.ndarray) -> np.ndarray:
    return angle - 2 * np.pi * np.rint(angle / (2 * np.pi))


class Plan:
    """What a stem's map asks for: its output length, the number of output frames and where each reads."""

    def __init__(self, n: int, anchors: tuple, n_fft: int, hop: int):
        self.n, self.anchors, self.n_fft, self.hop = n, anchors, n_fft, hop
        self.length = int(round(anchors[0][-1]))
        self.frames = -(-self.length // hop) + 2
        self.last = n // hop  # the last source frame

    @property
    def moves(self) -> bool:
        """Whether there is anything to do; stems shorter than a frame are left as they are."""
        return not np.allclose(self.anchors[0], self.anchors[1]) and min(self.length, self.n) >= self.n_fft

    def reads(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The source frame before each of the output frames lo to hi, and the share of the one after it."""
        steps = np.clip(cubic(self.anchors, np.arange(lo, hi) * float(self.hop)), 0, self.n - 1) / self.hop
        k = np.clip(np.floor(steps).astype(np.int64), 0, self.last)
        return k, np.clip(steps - k, 0, 1)

    def reach(self) -> int:
        """Frames on either side of a block that its samples hear."""
        return -(-self.n_fft // self.hop)

    def block_frames(self, block: int, size: int) -> tuple[int, int, int]:
        """The first and last frame that a block synthesises, and the frame after its last one in the running sum."""
        reach = self.reach()
        return max(0, block * size - reach), min(self.frames, (block + 1) * size + reach), min(self.frames, max(0, (block + 1) * size - reach))

    def source(self, block: int, size: int) -> tuple[int, int]:
        """The source samples that a block reads."""
        lo, hi, _ = self.block_frames(block, size)
        k, _ = self.reads(lo, hi)
        return max(0, int(k.min()) * self.hop - self.n_fft // 2), min(self.n, (int(k.max()) + 1) * self.hop + self.n_fft // 2)

    def spectra(self, x: np.ndarray, start: int, k: np.ndarray) -> np.ndarray:
        """Spectra of source frames, each centred at k * hop, of samples that begin at ``start``; silence beyond the signal."""
        half = self.n_fft // 2
        picks = (k * self.hop - half - start)[:, None] + np.arange(self.n_fft)
        inside = (picks >= 0) & (picks < len(x))
        return np.fft.rfft(np.where(inside, x[np.clip(picks, 0, len(x) - 1)], 0.0) * hann(self.n_fft), axis=1)

    def advance(self, mono: np.ndarray, start: int, lo: int, hi: int) -> np.ndarray:
        """How far each bin turns from each of the output frames to the next."""
        k, _ = self.reads(lo, hi)
        here, there = (np.angle(self.spectra(mono, start, j)) for j in (k, np.minimum(k + 1, self.last)))
        due = 2 * np.pi * self.hop * np.arange(self.n_fft // 2 + 1) / self.n_fft
        return due + wrapped(there - here - due)

    def synthesise(self, x: np.ndarray, start: int, block: int, size: int, carried: np.ndarray) -> np.ndarray:
        """The block's output, a row a channel; ``carried`` is the phase that its first frame starts from."""
        lo, hi, _ = self.block_frames(block, size)
        k, share = self.reads(lo, hi)
        mono = x.mean(0)
        turned = np.cumsum(self.advance(mono, start, lo, hi), 0)
        phase = carried + np.concatenate((np.zeros((1, turned.shape[1])), turned[:-1]))
        guide = self.spectra(mono, start, k)
        rotation = np.take_along_axis(wrapped(phase - np.angle(guide)), owners(np.abs(guide)), 1)
        win, first, end = hann(self.n_fft), block * size * self.hop, min(self.length, (block + 1) * size * self.hop)
        out, weight = np.zeros((len(x), max(0, end - first))), np.zeros(max(0, end - first))
        begins = np.arange(lo, hi) * self.hop - self.n_fft // 2 - first
        for c, channel in enumerate(x):
            left = self.spectra(channel, start, k)
            size_left, right = np.abs(left), np.abs(self.spectra(channel, start, np.minimum(k + 1, self.last)))
            unit = np.divide(left, size_left, out=np.ones_like(left), where=size_left > 0)
            mixed = (1 - share)[:, None] * size_left + share[:, None] * right
            frames = np.fft.irfft(mixed * unit * np.exp(1j * rotation), self.n_fft, axis=1) * win
            for begin, frame in zip(begins, frames, strict=True):
                a, b = max(0, begin), min(out.shape[1], begin + self.n_fft)
                if a < b:
                    out[c, a:b] += frame[a - begin : b - begin]
                    if not c:
                        weight[a:b] += (win * win)[a - begin : b - begin]
        return out / np.where(weight > 1e-10, weight, 1.0)


def owners(magnitude: np.ndarray) -> np.ndarray:
    """For each bin of each frame the nearest peak, the lower one of two as near; a peak is no lower than its neighbours."""
    rise = np.diff(magnitude, axis=1) >= 0
    fall = np.diff(magnitude, axis=1) <= 0
    edge = np.ones((len(magnitude), 1), bool)
    peaks = np.hstack((edge, rise)) & np.hstack((fall, edge))
    found = np.empty(magnitude.shape, np.int64)
    bins = np.arange(magnitude.shape[1])
    for row, marks in zip(found, peaks, strict=True):
        at = np.flatnonzero(marks)
        row[:] = at[np.searchsorted((at[1:] + at[:-1]) / 2, bins)]
    return found


def cell(value) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False).astype(float)


def gathered(table: pa.Table) -> tuple[np.ndarray, int]:
    """The samples of a block's source, a row a channel, and the first one's place."""
    rows = sorted(zip(table.column("ch").to_pylist(), table.column("sblock").to_pylist(), range(table.num_rows), strict=True))
    channels: dict[int, list[np.ndarray]] = {}
    for ch, _, r in rows:
        channels.setdefault(ch, []).append(cell(table.column("x")[r]))
    parts = [np.concatenate(v) for v in channels.values()]
    n = min(map(len, parts))
    return np.stack([p[:n] for p in parts]), rows[0][1] * table.column("ssize")[0].as_py()


def plan_of(table: pa.Table, n_fft: int, hop: int) -> Plan:
    return Plan(table.column("n")[0].as_py(), tuple(cell(table.column(c)[0]) for c in ("dst", "src", "slope")), n_fft, hop)


def warp_blocks(blocks: DataFrame, anchors: DataFrame, n_fft: int = 2048, hop: int = 512, size: int = SIZE, frames: int = FRAMES) -> DataFrame:
    """(sig, ch, block, y): output blocks of ``frames`` * hop samples; blocks (sig, ch, block, x) of ``size``, anchors (sig, src, dst).

    Only signals whose map moves something come out; a signal without anchors, with the identity or shorter than a frame doesn't.
    All channels of a signal count as equally long (the shortest one's length). The result doesn't depend on ``size`` or ``frames``.
    """
    ends = blocks.groupBy("sig", "ch").agg(F.sum(F.size("x")).cast("long").alias("n")).groupBy("sig").agg(F.min("n").alias("n"))
    row = F.sort_array(F.collect_list(F.struct("dst", "src", "slope")))
    maps = timing.with_slopes(anchors.groupBy("sig", "dst").agg(F.max("src").alias("src"))).groupBy("sig").agg(row.alias("m"))
    maps = maps.select("sig", *(F.col(f"m.{c}").cast("array<double>").alias(c) for c in ("dst", "src", "slope"))).join(ends, "sig")

    def asked(parts):
        import pandas as pd

        for part in parts:
            rows = []
            for sig, n, *m in zip(part.sig, part.n, part.dst, part.src, part.slope, strict=True):
                plan = Plan(int(n), tuple(np.asarray(v, float) for v in m), n_fft, hop)
                if len(m[0]) < 2 or not plan.moves:
                    continue
                for block in range(-(-plan.frames // frames)):
                    first, end = plan.source(block, frames)
                    rows += [(sig, block, k) for k in range(first // size, -(-end // size))]
            yield pd.DataFrame(rows, columns=["sig", "block", "sblock"])

    wanted = maps.mapInPandas(asked, "sig long, block long, sblock long")
    moved = blocks.select("sig", F.col("ch").cast("long").alias("ch"), F.col("block").cast("long").alias("sblock"), "x", F.lit(size).alias("ssize"))
    reads = moved.join(wanted, ["sig", "sblock"]).join(maps, "sig")

    def advances(table: pa.Table) -> pa.Table:
        plan, (x, start), block = plan_of(table, n_fft, hop), gathered(table), table.column("block")[0].as_py()
        lo, _, hi = plan.block_frames(block, frames)
        turn = plan.advance(x.mean(0), start, lo, hi).sum(0) if hi > lo else np.zeros(n_fft // 2 + 1)
        if not block:
            turn = turn + np.angle(plan.spectra(x.mean(0), start, plan.reads(0, 1)[0]))[0]
        return pa.table({"sig": table.column("sig").slice(0, 1), "block": table.column("block").slice(0, 1), "turn": pa.array([turn], pa.list_(pa.float64()))})

    sums = reads.groupBy("sig", "block").applyInArrow(advances, "sig long, block long, turn array<double>")

    def carry(pdf):
        import pandas as pd

        pdf = pdf.sort_values("block")
        turns = np.stack(pdf.turn.to_numpy())
        total = np.concatenate((np.zeros((1, turns.shape[1])), np.cumsum(turns, 0)[:-1]))
        return pd.DataFrame({"sig": pdf.sig, "block": pdf.block, "carried": list(total)})

    carried = sums.groupBy("sig").applyInPandas(carry, "sig long, block long, carried array<double>")

    def played(left: pa.Table, right: pa.Table) -> pa.Table:
        plan, (x, start), block = plan_of(left, n_fft, hop), gathered(left), left.column("block")[0].as_py()
        phase = cell(right.column("carried")[0])
        if not block:
            phase = phase + np.angle(plan.spectra(x.mean(0), start, plan.reads(0, 1)[0]))[0]
        y = plan.synthesise(x, start, block, frames, phase)
        names = sorted(set(left.column("ch").to_pylist()))
        sig = left.column("sig")[0].as_py()
        return pa.table({"sig": pa.array([sig] * len(y), pa.int64()), "ch": pa.array(names, pa.int64()), "block": pa.array([block] * len(y), pa.int64()), "y": pa.array(list(y), pa.list_(pa.float64()))})

    carried = carried.select(F.col("sig").alias("csig"), F.col("block").alias("cblock"), "carried")
    out = reads.groupBy("sig", "block").cogroup(carried.groupBy("csig", "cblock")).applyInArrow(played, "sig long, ch long, block long, y array<double>")
    return out.where(F.size("y") > 0)


def warp_arrays(stems: DataFrame, anchors: DataFrame, n_fft: int = 2048, hop: int = 512, size: int = SIZE, frames: int = FRAMES) -> DataFrame:
    """(sig, ch, y): whole channels (sig, ch, x) read through their maps, for channels that fit into a row."""
    from sigloom.operators.blocks import from_blocks, to_blocks

    return from_blocks(warp_blocks(to_blocks(stems, size), anchors, n_fft, hop, size, frames), "y").withColumnRenamed("x", "y")
