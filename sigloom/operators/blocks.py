"""Long signals as blocks, so that one signal spreads over tasks.

Blocks are rows (sig, ch, block, x): ``size`` samples each from sample block * size on, the last one shorter. What a block needs
of its neighbours is sent to it: samples as a halo, or the state of a filter as four numbers.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.kernels import k_weighting
from sigloom.operators.timing import window_scores

SIZE = 1 << 16
KEY = ["sig", "ch", "block"]


def to_blocks(signals: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of (sig, ch, x array); a null or empty array has none."""
    count = F.ceil(F.coalesce(F.size("x"), F.lit(0)) / size).cast("int")
    spread = signals.withColumn("block", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
    return spread.select("sig", "ch", F.col("block").cast("long").alias("block"), F.slice("x", F.col("block") * size + 1, F.lit(size)).alias("x"))


def from_blocks(blocks: DataFrame, x: str = "x") -> DataFrame:
    """(sig, ch, x): the blocks of a channel strung together; for channels that fit into a row."""
    rows = F.sort_array(F.collect_list(F.struct("block", F.col(x).alias("x"))))
    return blocks.groupBy("sig", "ch").agg(F.flatten(F.transform(rows, lambda r: r.x)).alias("x"))


def with_halo(blocks: DataFrame, before: int, after: int) -> DataFrame:
    """Adds ``head``, up to ``before`` samples of the block before, and ``tail``, up to ``after`` of the next one.

    Both are empty at the ends of a signal. Only the halos are sent to their neighbours, before they are joined.
    """
    out = blocks
    for name, far, step in (("head", before, 1), ("tail", after, -1)):
        if not far:
            out = out.withColumn(name, F.array().cast("array<double>"))
            continue
        part = F.slice("x", -F.least(F.lit(far), F.size("x")), F.lit(far)) if step > 0 else F.slice("x", F.lit(1), F.lit(far))
        sent = blocks.where(F.size("x") > 0).select("sig", "ch", (F.col("block") + step).alias("block"), part.alias(name))
        out = out.join(sent, KEY, "left").withColumn(name, F.coalesce(name, F.array().cast("array<double>")))
    return out


def per_block(blocks: DataFrame, columns: list[str], function, ddl: str, schema: pa.Schema) -> DataFrame:
    """``function(key values, arrays) -> rows`` over the rows of blocks; arrays come as numpy."""

    def run(batches):
        for batch in batches:
            keys = [batch.column(i).to_pylist() for i in range(3)]
            rows = []
            for r in range(batch.num_rows):
                cells = [batch.column(3 + i)[r] for i in range(len(columns))]
                rows += function(tuple(k[r] for k in keys), [np.asarray(c.values, float) if c.is_valid else np.zeros(0) for c in cells])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema)

    return blocks.select(*KEY, *columns).mapInArrow(run, ddl)


class Cascade:
    """Second-order sections one after the other, in transposed form: two numbers of state each."""

    STEP = 128

    def __init__(self, sections: tuple):
        self.sections = [(np.array(b, float), np.array(a, float)) for b, a in sections]
        self.tables = [self._table(b, a) for b, a in self.sections]
        self.order = 2 * len(self.sections)

    def _table(self, b, a):
        """For a stretch of STEP samples: responses to the state and to each sample, and what they leave in the state."""
        n = self.STEP
        out, left = np.zeros((n, n + 2)), np.zeros((2, n + 2))
        for column in range(n + 2):
            z1, z2 = float(column == 0), float(column == 1)
            for k in range(n):
                x = float(column == k + 2)
                y = b[0] * x + z1
                z1, z2 = b[1] * x - a[0] * y + z2, b[2] * x - a[1] * y
                out[k, column] = y
            left[:, column] = z1, z2
        return out, left

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The output of a stretch of any length that is entered with a state, and the state it is left with."""
        state = np.zeros(self.order) if state is None else np.array(state, float)
        n = self.STEP
        for s, ((b, a), (out, left)) in enumerate(zip(self.sections, self.tables, strict=True)):
            z, y = state[2 * s : 2 * s + 2], np.empty(len(x))
            whole = len(x) // n * n
            pieces = x[:whole].reshape(-1, n)
            rest, ends = pieces @ out[:, 2:].T, pieces @ left[:, 2:].T
            for i in range(len(pieces)):
                rest[i] += out[:, :2] @ z
                z = left[:, :2] @ z + ends[i]
            y[:whole] = rest.ravel()
            z1, z2 = z
            for k in range(whole, len(x)):
                y[k] = b[0] * x[k] + z1
                z1, z2 = b[1] * x[k] - a[0] * y[k] + z2, b[2] * x[k] - a[1] * y[k]
            state[2 * s : 2 * s + 2] = z1, z2
            x = y
        return x, state

    @lru_cache(maxsize=16)  # noqa: B019 - cascades are few and cached themselves
    def free(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """What n samples of silence give from each unit state, and the states they leave: the two affine parts of a block."""
        runs = [self.run(np.zeros(n), unit) for unit in np.eye(self.order)]
        return np.stack([r[0] for r in runs], 1), np.stack([r[1] for r in runs], 1)


@lru_cache(maxsize=8)
def cascade(sections: tuple) -> Cascade:
    return Cascade(sections)


def entry_states(ends: DataFrame, sections: tuple) -> DataFrame:
    """(sig, ch, block, state): the state in which the filter enters each block; ends (sig, ch, block, n, state).

    ``state`` is what a block leaves if it is entered at rest. A block of n samples maps the state s it is entered with to
    T(n) s + state, with one matrix T for all blocks of a length. These maps, four numbers a block, are folded in order by signal.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("block")
        state, found = np.zeros(2 * len(sections)), []
        for n, left in zip(pdf.n, pdf.state, strict=True):
            found.append(state.tolist())
            state = cascade(sections).free(int(n))[1] @ state + np.asarray(left)
        return pd.DataFrame({"sig": pdf.sig, "ch": pdf.ch, "block": pdf.block, "state": found})

    return ends.groupBy("sig", "ch").applyInPandas(run, "sig long, ch long, block long, state array<double>")


def block_ends(blocks: DataFrame, sections: tuple) -> DataFrame:
    """(sig, ch, block, n, state): what the filter leaves after each block entered at rest."""
    schema = pa.schema([*((k, pa.int64()) for k in KEY), ("n", pa.int64()), ("state", pa.list_(pa.float64()))])
    one = lambda key, cells: [(*key, len(cells[0]), cascade(sections).run(cells[0])[1].tolist())]
    return per_block(keyed(blocks), ["x"], one, "sig long, ch long, block long, n long, state array<double>", schema)


def keyed(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({k: F.col(k).cast("long") for k in KEY})


def filtered(blocks: DataFrame, sections: list[tuple]) -> DataFrame:
    """Blocks after a cascade of second-order sections (b, a1 and a2), exactly as in one pass over the whole signal."""
    sections = tuple((tuple(b), tuple(a)) for b, a in sections)
    states = entry_states(block_ends(blocks, sections), sections)
    schema = pa.schema([*((k, pa.int64()) for k in KEY), ("x", pa.list_(pa.float64()))])
    one = lambda key, cells: [(*key, cascade(sections).run(cells[0], cells[1])[0])]
    return per_block(keyed(blocks).join(states, KEY), ["x", "state"], one, "sig long, ch long, block long, x array<double>", schema)


def k_weighted(blocks: DataFrame, sr: float) -> DataFrame:
    """Blocks of the K-weighted signal."""
    return filtered(blocks, k_weighting(sr))


def k_weighted_power(blocks: DataFrame, sr: float, size: int, window: int, hop: int) -> DataFrame:
    """(sig, frame, power): mean squares of K-weighted frames, summed over the channels; no sample is shuffled.

    With G the response to a state, a stretch at rest y becomes y + G s when its block is entered with state s. So its power is
    y.y + 2 s.(G'y) + s.(G'G)s: three small things a stretch, joined with the state. Stretches have the greatest length
    that divides window, hop and ``size``. Frames are those that fit into the signal, the last one too.
    """
    sections = tuple((tuple(b), tuple(a)) for b, a in k_weighting(sr))
    unit = math.gcd(math.gcd(window, hop), size)
    blocks = keyed(blocks)

    def stretches(key, cells):
        filter_, x = cascade(sections), cells[0]
        y, left = filter_.run(x)
        g = filter_.free(size)[0][: len(x)]
        rows = []
        for u in range(0, len(x), unit):
            yu, gu = y[u : u + unit], g[u : u + unit]
            rows.append((*key, u // unit, len(yu), float(yu @ yu), (gu.T @ yu).tolist(), (gu.T @ gu).ravel().tolist()))
        rows.append((*key, -1, len(x), None, left.tolist(), None))
        return rows

    schema = pa.schema([*((k, pa.int64()) for k in KEY), ("u", pa.int64()), ("n", pa.int64()), ("p", pa.float64()), ("g", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))])
    ddl = "sig long, ch long, block long, u long, n long, p double, g array<double>, q array<double>"
    found = per_block(blocks, ["x"], stretches, ddl, schema)
    states = entry_states(found.where("u < 0").select(*KEY, "n", F.col("g").alias("state")), sections)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    outer = F.flatten(F.transform("state", lambda x: F.transform("state", lambda y: x * y)))
    each = found.where("u >= 0").join(states, KEY).select(
        "sig", "ch", (F.col("block") * (size // unit) + F.col("u")).alias("b"), "n", (F.col("p") + 2 * dot("state", "g") + dot(outer, "q")).alias("p")
    )
    per = each.groupBy("sig", "b").agg(F.sum("p").alias("p"), F.max("n").alias("n"))
    wide = window // unit
    low, high = F.expr(f"greatest(0L, ((b - {wide}) * {unit} + {hop}) div {hop})"), F.expr(f"b * {unit} div {hop}")
    spread = per.where(F.col("n") == unit).select("sig", "p", low.alias("low"), high.alias("high")).where("low <= high")
    spread = spread.select("sig", "p", F.explode(F.sequence("low", "high")).alias("frame"))
    frames = spread.groupBy("sig", "frame").agg(F.sum("p").alias("p"), F.count("*").alias("n")).where(F.col("n") == wide)
    return frames.select("sig", "frame", (F.col("p") / window).alias("power"))


def max_step(blocks: DataFrame) -> DataFrame:
    """(sig, ch, step): largest change between neighbours over the peak, as :func:`levels.max_step`; one sample is carried."""
    inner = F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), lambda a, b: F.abs(b - a))
    ends = blocks.where(F.size("x") > 0).select(
        *KEY, F.when(F.size("x") > 1, F.array_max(inner)).alias("step"), F.array_max(F.transform("x", F.abs)).alias("peak"), F.get("x", F.lit(0)).alias("first"), F.element_at("x", -1).alias("last")
    )
    carried = F.lag("last").over(Window.partitionBy("sig", "ch").orderBy("block"))
    ends = ends.withColumn("edge", F.abs(F.col("first") - carried))
    step = F.max(F.greatest("step", "edge")) / F.nullif(F.max("peak"), F.lit(0.0))
    return ends.groupBy("sig", "ch").agg(F.coalesce(step, F.lit(0.0)).alias("step"))


def coherence(pairs: DataFrame, size: int, n: int, sr: float, low: float, high: float) -> DataFrame:
    """(sig, coherence): as :func:`kernels.welch_coherence`, of blocks (sig, block, x, y) of ``size`` samples, a multiple of n / 2.

    A frame belongs to the block that it begins in; its cross-spectra are summed there, then by signal. Silence on either side
    gives null.
    """
    if size % (n // 2) or size < n:
        raise ValueError("blocks have to hold a frame and a whole number of hops")
    sides = [with_halo(pairs.select("sig", F.lit(0).alias("ch"), "block", F.col(c).alias("x")), 0, n).select(*KEY, F.concat("x", "tail").alias(c)) for c in "xy"]
    hz = np.arange(n // 2 + 1) * sr / n
    inside = (hz >= low) & (hz <= high)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)

    def sums(key, cells):
        m = min(map(len, cells))
        starts = np.arange(0, min(size, m - n + 1), n // 2)
        if not len(starts) or not inside.any():
            return []
        spectra = []
        for x in cells:
            frames = np.lib.stride_tricks.sliding_window_view(x[:m], n)[starts]
            spectra.append(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * win, axis=1)[:, inside])
        u, v = spectra
        cross = (np.conj(u) * v).sum(0)
        parts = [(np.abs(u) ** 2).sum(0), (np.abs(v) ** 2).sum(0), cross.real, cross.imag]
        return [(*key, *(p.tolist() for p in parts))]

    names = ["xx", "yy", "re", "im"]
    schema = pa.schema([*((k, pa.int64()) for k in KEY), *((c, pa.list_(pa.float64())) for c in names)])
    ddl = "sig long, ch long, block long, " + ", ".join(f"{c} array<double>" for c in names)
    found = per_block(keyed(sides[0].join(sides[1], KEY)), ["x", "y"], sums, ddl, schema)
    bins = found.select("sig", F.posexplode(F.arrays_zip(*names)).alias("bin", "v")).groupBy("sig", "bin").agg(*(F.sum(f"v.{c}").alias(c) for c in names))
    each = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.nullif(F.col("xx") * F.col("yy"), F.lit(0.0))
    long = pairs.groupBy("sig").agg((F.sum(F.least(F.size("x"), F.size("y"))) > n).alias("long"))
    return long.join(bins.groupBy("sig").agg(F.avg(each).alias("c")), "sig", "left").select("sig", F.when(F.col("long"), F.col("c")).alias("coherence"))


class Tracker:
    """Follows the offset of b against a over samples that come in stretches; see :func:`kernels.track_offsets`.

    What is kept between stretches is the offset, the next window's number and the samples that later windows may need.
    """

    def __init__(self, window: int, hop: int, search: int, overall: int = 0):
        self.window, self.hop, self.search, self.overall = window, hop, search, abs(overall)
        self.running, self.w, self.start_a, self.start_b, self.seen = None, 0, 0, 0, 0
        self.a = self.b = np.zeros(0)

    def state(self) -> dict:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}

    @classmethod
    def resumed(cls, state: dict) -> Tracker:
        new = cls.__new__(cls)
        new.__dict__.update({k: np.array(v, float) if k in "ab" else v for k, v in state.items()})
        return new

    def feed(self, a: np.ndarray, b: np.ndarray, last: bool = False):
        """Takes the next samples of both sides, as many of each unless they are the last; gives (w, lag, score) of each window done."""
        self.a, self.b = np.concatenate((self.a, a)), np.concatenate((self.b, b))
        while True:
            at = self.w * self.hop
            end_a = self.start_a + len(self.a)
            # A window counts if a sample follows it, as in a loop over starts below len - window.
            if at + self.window >= end_a:
                break
            centre, radius = (at, max(self.search, self.overall + self.search)) if self.running is None else (at + self.running, self.search)
            low, high = max(0, centre - radius), centre + self.window + radius
            if not last and high > self.start_b + len(self.b):
                break
            self.w += 1
            x = self.a[at - self.start_a :][: self.window]
            if np.sqrt(np.mean(x * x)) >= 1e-5:
                wide = self.b[max(0, low - self.start_b) : max(0, max(low, high) - self.start_b)]
                if len(wide) > self.window:
                    scores = window_scores(x, wide)
                    best = int(np.argmax(np.round(scores, 9)))
                    lag = low + best - at
                    if self.running is None or abs(lag - self.running) <= self.search:
                        self.running = lag
                        yield self.w - 1, lag, float(scores[best])
            self._forget()
        self._forget()

    def _forget(self):
        at = self.w * self.hop
        keep_a = min(at, self.start_a + len(self.a))
        self.a, self.start_a = self.a[keep_a - self.start_a :], keep_a
        radius = max(self.search, self.overall + self.search) if self.running is None else self.search
        keep_b = min(max(self.start_b, at + (self.running or 0) - radius), self.start_b + len(self.b))
        self.b, self.start_b = self.b[keep_b - self.start_b :], keep_b


def track_offsets(pairs: DataFrame, window: int, hop: int, search: int, overall: str | None = None) -> DataFrame:
    """(sig, w, lag, score): as :func:`kernels.track_offsets`, of blocks (sig, block, a, b).

    Each window depends on the one before, so a signal stays in one task; but it passes through it block by block, and memory is
    that of a few blocks, whatever the length of the signal. Both sides have as many samples in every block but the last.
    """
    data = pairs.select("sig", "block", "a", "b", (F.col(overall) if overall else F.lit(0)).cast("long").alias("o"))

    def run(batches):
        import pandas as pd

        sig, tracker, held = None, None, None

        def fed(last):
            return [(sig, *row) for row in tracker.feed(*held, last)] if held else []

        for batch in batches:
            rows = []
            for s, a, b, o in zip(batch.sig, batch.a, batch.b, batch.o, strict=True):
                if s != sig:
                    rows += fed(True) if tracker else []
                    sig, tracker, held = s, Tracker(window, hop, search, int(o)), None
                rows += fed(False)
                held = (np.asarray(a, float), np.nan_to_num(np.asarray(b, float)))
            yield pd.DataFrame(rows, columns=["sig", "w", "lag", "score"])
        if tracker:
            yield pd.DataFrame(fed(True), columns=["sig", "w", "lag", "score"])

    return data.repartition("sig").sortWithinPartitions("sig", "block").mapInPandas(run, "sig long, w long, lag long, score double")
