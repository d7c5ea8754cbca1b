"""Beats, tempo, warp maps, regions and correlation of signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.numeric import first_best
from sigloom.operators import levels


def tempo_stability(b: DataFrame) -> DataFrame:
    """Beats per minute from (sig, t): gaps over their number of intervals, outliers dropped only if three stay.

    Fewer than four beats give nulls.
    """
    order = Window.partitionBy("sig").orderBy("t")
    g = b.select("sig", (F.col("t") - F.lag("t").over(order)).alias("gap"))
    n = g.groupBy("sig").agg(F.count("*").alias("n_beats"), F.median("gap").alias("iv"))
    per = F.col("gap") / F.greatest(F.lit(1.0), F.rint(F.col("gap") / F.nullif("iv", F.lit(0.0))))
    p = g.where("gap is not null").join(n, "sig").where("n_beats >= 4").withColumn("per", per)
    p = p.withColumn("ok", (F.col("per") > 0.5 * F.col("iv")) & (F.col("per") < 2 * F.col("iv")))
    p = p.withColumn("n_ok", F.sum(F.col("ok").cast("int")).over(Window.partitionBy("sig"))).where("n_ok < 3 or ok")
    bpm = 60 / F.nullif("per", F.lit(0.0))
    q = p.withColumn("bpm", bpm).groupBy("sig").agg(F.median("bpm").alias("bpm_median"), F.stddev_pop("bpm").alias("bpm_std"), F.min("bpm").alias("bpm_min"), F.max("bpm").alias("bpm_max"))
    return n.select("sig", "n_beats").join(q, "sig", "left")


#: Rates outside this range, or nearer to 1 than the step, leave a segment as it is.
RATE_LOW, RATE_HIGH, RATE_STEP = 0.80, 1.25, 0.005


def warp_anchors(b: DataFrame, sr: int, n: DataFrame) -> DataFrame:
    """(sig, src, dst): samples of a strictly rising map to an even grid; b (sig, t), n (sig, n) lengths.

    Beats are rounded half to even, clipped, made distinct and kept inside 0 < b < n. Fewer than two beats give the
    identity's two anchors.
    """
    gaps = b.select("sig", (F.col("t") - F.lag("t").over(Window.partitionBy("sig").orderBy("t"))).alias("gap"))
    target = gaps.groupBy("sig").agg(F.rint(F.median("gap") * sr).cast("long").alias("target"))
    s = b.join(n, "sig").select("sig", "n", F.least(F.greatest(F.rint(F.col("t") * sr), F.lit(0.0)), F.col("n").cast("double")).cast("long").alias("src"))
    s = s.distinct().where("src > 0 and src < n").join(target, "sig")
    order = Window.partitionBy("sig").orderBy("src")
    s = s.withColumn("len", F.lead("src").over(order) - F.col("src")).withColumn("many", F.count("*").over(Window.partitionBy("sig"))).where("many >= 2")
    steps = F.greatest(F.lit(1.0), F.rint(F.col("len") / F.col("target"))) * F.col("target")
    rate = F.col("len") / steps
    s = s.withColumn("to", F.when((rate < RATE_LOW) | (rate > RATE_HIGH) | (F.abs(rate - 1) < RATE_STEP), F.col("len").cast("double")).otherwise(steps).cast("long"))
    first = F.first("src").over(order.rowsBetween(Window.unboundedPreceding, 0))
    done = F.coalesce(F.sum("to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("dst", first + done)
    inner = s.select("sig", "src", "dst")
    tail = s.where("len is null").select("sig", F.col("n").alias("src"), (F.col("dst") + F.col("n") - F.col("src")).alias("dst"))
    head = n.select("sig", F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
    bare = n.join(s.select("sig").distinct(), "sig", "left_anti").select("sig", F.col("n").alias("src"), F.col("n").alias("dst"))
    return head.unionByName(inner).unionByName(tail).unionByName(bare)


def describe_warp(anchors: DataFrame) -> DataFrame:
    """Segments, corrected segments, median and largest correction in %, and the change of length in %."""
    order = Window.partitionBy("sig").orderBy("src")
    a = anchors.select("sig", "src", "dst", (F.col("src") - F.lag("src").over(order)).alias("ds"), (F.col("dst") - F.lag("dst").over(order)).alias("dd"))
    c = F.when(F.col("ds") != F.col("dd"), 100 * F.abs(F.col("dd") / F.nullif("ds", F.lit(0)) - 1))
    g = a.withColumn("c", c).groupBy("sig").agg(
        F.count("ds").alias("segments"), F.count("c").alias("corrected"), F.coalesce(F.median("c"), F.lit(0.0)).alias("median_pct"),
        F.coalesce(F.max("c"), F.lit(0.0)).alias("max_pct"), F.max("src").alias("src"), F.max("dst").alias("dst"),
    )
    return g.select("sig", "segments", "corrected", "median_pct", "max_pct", (100 * (F.col("dst") / F.nullif("src", F.lit(0)) - 1)).alias("length_pct"))


def with_slopes(anchors: DataFrame) -> DataFrame:
    """Adds the slope of a monotone cubic at each anchor: the weighted harmonic mean of the secants beside it.

    It is 0 where the secants differ in sign. Ends take a three-point estimate, limited so that the curve doesn't
    overshoot; with two anchors every slope is the secant's, so that the curve is the line.
    """
    order = Window.partitionBy("sig").orderBy("dst")
    x, y = F.col("dst"), F.col("src")
    a = anchors.select("sig", "dst", F.col("src").cast("double").alias("src"), (F.lead(x).over(order) - x).cast("double").alias("h1"), ((F.lead(y).over(order) - y) / F.nullif(F.lead(x).over(order) - x, F.lit(0))).alias("m1"))
    a = a.select("*", *(F.lag(c).over(order).alias(n) for c, n in (("h1", "h0"), ("m1", "m0"))), *(F.lead(c).over(order).alias(n) for c, n in (("h1", "h2"), ("m1", "m2"))))
    a = a.select("*", *(F.lag(c, 2).over(order).alias(n) for c, n in (("h1", "hb"), ("m1", "mb"))))
    u, v = 2 * F.col("h1") + F.col("h0"), F.col("h1") + 2 * F.col("h0")
    middle = F.when(F.col("m0") * F.col("m1") > 0, (u + v) / (u / F.nullif("m0", F.lit(0.0)) + v / F.nullif("m1", F.lit(0.0)))).otherwise(0.0)

    def end(h, m, h_next, m_next):
        h, m, h_next, m_next = map(F.col, (h, m, h_next, m_next))
        d = ((2 * h + h_next) * m - h * m_next) / (h + h_next)
        limited = F.when((F.signum(m) != F.signum(m_next)) & (F.abs(d) > 3 * F.abs(m)), 3 * m).otherwise(d)
        return F.when(m_next.isNull(), m).when(F.signum(d) != F.signum(m), 0.0).otherwise(limited)

    slope = F.when(F.col("m0").isNull(), end("h1", "m1", "h2", "m2")).when(F.col("m1").isNull(), end("h0", "m0", "hb", "mb")).otherwise(middle)
    return a.select("sig", "dst", "src", slope.alias("slope"))


def read_warp(anchors: DataFrame, positions: DataFrame) -> DataFrame:
    """(sig, dst, src): positions (sig, dst) read through the map by a monotone cubic between the anchors around them."""
    known = with_slopes(anchors).select("sig", F.col("dst").cast("double").alias("dst"), "src", "slope", F.lit(True).alias("mark"))
    asked = positions.select("sig", F.col("dst").cast("double").alias("dst"), *(F.lit(None).cast("double").alias(c) for c in ("src", "slope")), F.lit(False).alias("mark"))
    order = Window.partitionBy("sig").orderBy("dst", F.desc("mark"))
    here = F.when(F.col("mark"), F.struct("dst", "src", "slope"))
    low = F.last(here, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(here, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = known.unionByName(asked).withColumns({"a": F.coalesce(low, high), "b": F.coalesce(high, low)}).where("not mark")
    h = F.col("b.dst") - F.col("a.dst")
    t = F.coalesce((F.col("dst") - F.col("a.dst")) / F.nullif(h, F.lit(0.0)), F.lit(0.0))
    rise = F.col("b.src") - F.col("a.src")
    bend = t * (1 - t) * (h * ((1 - t) * F.col("a.slope") - t * F.col("b.slope")) + (2 * t - 1) * rise)
    return both.select("sig", F.col("dst").cast(positions.schema["dst"].dataType).alias("dst"), (F.col("a.src") + t * rise + bend).alias("src"))


def risk_region(f: DataFrame, dt: float, least: float = 0.4, merge_s: float = 1.0, min_s: float = 1.0, pad_s: float = 0.25) -> DataFrame:
    """(sig, threshold, start, end, inside): the longest stretch of risk (sig, k, x), widened and padded, and its mean.

    Frames above max(mean + 1.5 deviations, ``least``) form runs; runs no more than int(merge_s / dt) apart merge; of
    equally long ones the first counts. Signals without such a frame have nulls.
    """
    w = Window.partitionBy("sig")
    order = w.orderBy("k")
    gap = int(merge_s / dt)
    t = f.groupBy("sig").agg(F.greatest(F.avg("x") + 1.5 * F.stddev_pop("x"), F.lit(least)).alias("threshold"))
    up = f.join(t, "sig").where("x > threshold").select("sig", "k")
    # A frame opens a merged run if the one above before it is more than the allowed gap away.
    fresh = F.when(F.col("k") - F.lag("k").over(order) - 1 <= gap, 0).otherwise(1)
    runs = up.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order)).groupBy("sig", "run").agg(F.min("k").alias("s"), F.max("k").alias("e"))
    best = runs.groupBy("sig").agg(first_best(F.struct("s", "e"), F.col("e") - F.col("s"), F.col("s")).alias("b")).select("sig", (F.col("b.s") * dt).alias("s"), (F.col("b.e") * dt).alias("e"))
    mid, half = (F.col("s") + F.col("e")) / 2, F.greatest((F.col("e") - F.col("s")) / 2, F.lit(min_s / 2))
    best = best.select("sig", F.greatest(mid - half - pad_s, F.lit(0.0)).alias("start"), (mid + half + pad_s).alias("end"))
    inside = f.join(best, "sig").where((F.col("k") * dt >= F.col("start")) & (F.col("k") * dt < F.col("end"))).groupBy("sig").agg(F.avg("x").alias("inside"))
    return t.join(best, "sig", "left").join(inside, "sig", "left").select("sig", "threshold", "start", "end", "inside")


def best_lag(ab: DataFrame, max_lag: int) -> DataFrame:
    """(pair, lag, score): the first lag with the highest normalised correlation; ab (pair, i, l, r), |lag| <= max_lag.

    Positive lags mean that r is late. Null and missing samples count as the side's mean; a side that doesn't vary gives lag
    and score 0. All lags come from one FFT of the pair, whose samples (envelopes for long signals) are one group.
    """

    def score(i, l, r):  # noqa: E741
        place = np.asarray(i, np.int64)
        place = place - place.min()
        sides = []
        for side in (l, r):
            x, v = np.zeros(int(place.max()) + 1), np.asarray(side, float)
            known = ~np.isnan(v)
            x[place[known]] = v[known] - v[known].mean() if known.any() else 0.0
            sides.append(x)
        norm = np.linalg.norm(sides[0]) * np.linalg.norm(sides[1])
        if not norm > 0:
            return 0, 0.0
        reach = min(max_lag, len(sides[0]) - 1)
        scores = lagged_products(*sides, reach) / norm
        return int(np.argmax(np.round(scores, 9))) - reach, float(scores.max())

    def run(parts):
        import pandas as pd

        for part in parts:
            found = [score(*row) for row in zip(part.i, part.l, part.r, strict=True)]
            yield pd.DataFrame({"pair": part.pair, "lag": [f[0] for f in found], "score": [f[1] for f in found]})

    return side_by_side(ab).mapInPandas(run, "pair long, lag long, score double")


def side_by_side(ab: DataFrame) -> DataFrame:
    """(pair, i, l, r): the samples (pair, i, l, r) of a pair as arrays in one row, by place."""
    rows = ab.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("i", "l", "r"))).alias("v"))
    return rows.select(F.col("pair").cast("long").alias("pair"), F.col("v.i").cast("array<bigint>").alias("i"), *(F.col(f"v.{c}").cast("array<double>").alias(c) for c in "lr"))


def lagged_products(l: np.ndarray, r: np.ndarray, reach: int) -> np.ndarray:  # noqa: E741
    """Sums of l[i] r[i + lag] for the lags from -reach to reach."""
    size = 1 << (len(l) + len(r)).bit_length()
    c = np.fft.irfft(np.conj(np.fft.rfft(l, size)) * np.fft.rfft(r, size), size)
    return np.concatenate((c[size - reach :], c[: reach + 1])) if reach else c[:1]


def window_scores(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Correlation of ``short`` with every window of ``long``; 0 where a side doesn't vary."""
    n, count = len(short), len(long) - len(short) + 1
    if not n or count < 1:
        return np.zeros(0)
    size = 1 << (n + len(long)).bit_length()
    centred, base = short - short.mean(), long.mean()
    long = long - base  # sums of squares stay small
    dots = np.fft.irfft(np.conj(np.fft.rfft(centred, size)) * np.fft.rfft(long, size), size)[:count]
    one, two = (np.concatenate(([0.0], np.cumsum(v))) for v in (long, long * long))
    var = (two[n:] - two[:-n]) - (one[n:] - one[:-n]) ** 2 / n
    own = float(centred @ centred)
    return np.where((var > 1e-12) & (own > 1e-12), dots / np.sqrt(np.maximum(var, 1e-30) * max(own, 1e-30)), 0.0)


def sliding_correlation(ab: DataFrame, short: int) -> DataFrame:
    """(pair, start, score): the first ``short`` samples of l against every window of r; 0 where a side doesn't vary."""

    def run(parts):
        import pandas as pd

        for part in parts:
            found = [window_scores(np.asarray(l, float)[:short], np.asarray(r, float)) for l, r in zip(part.l, part.r, strict=True)]  # noqa: E741
            sizes = [len(f) for f in found]
            starts = np.concatenate([np.zeros(0, int), *map(np.arange, sizes)])
            yield pd.DataFrame({"pair": np.repeat(part.pair.to_numpy(), sizes), "start": starts, "score": np.concatenate([np.zeros(0), *found])})

    return side_by_side(ab).mapInPandas(run, "pair long, start long, score double")


#: Fixed value: a window's offset counts from this correlation on.
CONFIDENT = 0.5


def correlation_summary(windows: DataFrame) -> DataFrame:
    """(pair, corr_min, corr_median, corr_mean, drift, max_offset, confident) of windows (pair, start, score).

    The correlations are those of all windows, so that damage isn't hidden. Drift, and the offset (``start``) furthest from 0,
    the positive one on ties, are of the windows with CONFIDENT or more, or of all where there are none; ``confident`` is their number.
    """
    sure = F.col("score") >= CONFIDENT
    g = windows.groupBy("pair").agg(
        F.min("score").alias("corr_min"), F.median("score").alias("corr_median"), F.avg("score").alias("corr_mean"), F.count("*").alias("n"),
        F.count_if(sure).alias("n_sure"), *(f(F.when(sure, F.col("start"))).alias(f"{n}_sure") for n, f in (("low", F.min), ("high", F.max))),
        F.min("start").alias("low"), F.max("start").alias("high"),
    )
    pick = lambda c: F.when(F.col("n_sure") > 0, F.col(f"{c}_sure")).otherwise(F.col(c))
    far = F.when(-pick("low") > pick("high"), pick("low")).otherwise(pick("high"))
    return g.select("pair", "corr_min", "corr_median", "corr_mean", (pick("high") - pick("low")).alias("drift"), far.alias("max_offset"), F.when(F.col("n_sure") > 0, F.col("n_sure")).otherwise(F.col("n")).alias("confident"))


def loudest_stretch(s: DataFrame, spans: DataFrame, hop: int) -> DataFrame:
    """(sig, start): the first of the loudest stretches that begin at a whole hop; spans (sig, span) in hops, each signal's own."""
    order = Window.partitionBy("sig").orderBy("b")
    full = levels.hop_powers(s, hop).where(F.col("n") == hop)
    sums = full.select("sig", "b", F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "p")
    ends = sums.select("sig", (F.col("b") + 1).alias("to"), "upto")
    each = sums.select("sig", "b", (F.col("upto") - F.col("p")).alias("before")).join(spans, "sig").withColumn("to", F.col("b") + F.col("span")).join(ends, ["sig", "to"])
    return each.groupBy("sig").agg(first_best(F.col("b") * hop, F.round(F.col("upto") - F.col("before"), 9), F.col("b")).alias("start"))


def estimate_offset(a: DataFrame, b: DataFrame, hop: int, coarse: int, fine: int, span: int | None, material: int = 1 << 40, least: int = 0) -> DataFrame:
    """(sig, coarse, offset, score): how many samples b is late, first by envelopes, then by samples; a, b (sig, i, x).

    Envelopes of ``hop`` samples are searched to ``coarse`` hops either way. Then a's loudest stretch of ``span`` hops slides
    over the wider stretch of b that reaches ``fine`` samples further either way, so every position compares as many samples
    and the sample step doesn't grow with the signals. Where b has no room for it the coarse offset stays, with score 0.
    Without a span each pair has its own: what the shorter of the two signals, or ``material``, leaves beside four times
    ``fine``, if that is more than ``least`` samples. So no row depends on other rows.
    """
    env = lambda s, n: levels.envelope(s, hop).select(F.col("sig").alias("pair"), F.col("b").alias("i"), F.col("env").alias(n))
    first = best_lag(env(a, "l").join(env(b, "r"), ["pair", "i"], "full"), coarse).select(F.col("pair").alias("sig"), (F.col("lag") * hop).alias("coarse"))
    ends = a.groupBy("sig").agg((F.max("i") + 1).alias("na")).join(b.groupBy("sig").agg((F.max("i") + 1).alias("nb")), "sig")
    if span is None:
        room = F.least("na", "nb", F.lit(material)) - 4 * fine
        spans = ends.select("sig", F.floor(room / hop).alias("span"), room.alias("room")).where((F.col("span") > 0) & (F.col("room") > least)).drop("room")
        loudest = loudest_stretch(a, spans, hop)
    else:
        spans = ends.select("sig", F.lit(span).cast("long").alias("span"))
        loudest = levels.loudest_start(a, span, hop).select("sig", "start")
    ends = ends.join(spans, "sig").withColumn("size", F.col("span") * hop)
    lowest = F.greatest(F.lit(0), fine - F.col("coarse"))
    highest = F.least(F.col("na") - F.col("size"), F.col("nb") - F.col("coarse") - F.col("size") - fine)
    start = loudest.join(first, "sig").join(ends, "sig").where(highest >= lowest)
    start = start.select("sig", "coarse", "size", F.least(F.greatest("start", lowest), highest).cast("long").alias("start"))
    near = a.join(start, "sig").select("sig", (F.col("i") - F.col("start") + fine).alias("i"), F.col("x").alias("l"), "size").where(F.col("i").between(F.lit(fine), fine + F.col("size") - 1))
    wide = b.join(start, "sig").select("sig", (F.col("i") - F.col("coarse") - F.col("start") + fine).alias("i"), F.col("x").alias("r"), F.col("size").alias("s2")).where(F.col("i").between(F.lit(0), F.col("s2") + 2 * fine - 1))

    def run(pdf):
        import pandas as pd

        size = int(pdf["size"].max() if pdf["size"].notna().any() else pdf.s2.max())
        x, y = np.zeros(size), np.zeros(size + 2 * fine)
        for v, c, shift in ((x, "l", fine), (y, "r", 0)):
            known = pdf[c].notna()
            v[pdf.i[known].to_numpy() - shift] = pdf[c][known]
        scores = window_scores(x, y)
        best = int(np.argmax(np.round(scores, 9)))
        return pd.DataFrame({"sig": [int(pdf.sig.iloc[0])], "lag": [best - fine], "score": [float(scores[best])]})

    found = near.join(wide, ["sig", "i"], "full").groupBy("sig").applyInPandas(run, "sig long, lag long, score double")
    lag, score = F.coalesce("lag", F.lit(0)), F.coalesce("score", F.lit(0.0))
    return first.join(found, "sig", "left").select("sig", "coarse", (F.col("coarse") + lag).alias("offset"), score.alias("score"))
