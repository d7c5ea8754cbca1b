"""Notes, donors, splices, chunks and names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUFFIXES = ("_restored", "_dry", "_wet", "_processed")  # fixed values, stripped once from names


def encode_notes(notes: DataFrame) -> DataFrame:
    """(sig, events): the wire form, triplets of onset, duration and note number, in the order of k."""
    triple = F.struct("k", F.rint(F.col("onset") * 100).cast("long").alias("a"), (10000 + F.rint(F.col("dur") * 100)).cast("long").alias("b"), (11000 + 128 * F.col("instrument") + F.col("pitch")).cast("long").alias("c"))
    g = notes.groupBy("sig").agg(F.sort_array(F.collect_list(triple)).alias("n"))
    return g.select("sig", F.flatten(F.transform("n", lambda x: F.array(x.a, x.b, x.c))).alias("events"))


def decode_notes(events: DataFrame) -> DataFrame:
    """(sig, k, onset, dur, pitch, instrument): whole triplets of the wire form; a trailing part is dropped."""
    n = F.floor(F.size("events") / 3).cast("int")
    spread = events.where(n > 0).select("sig", "events", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    at = lambda j: F.get("events", 3 * F.col("k") + j)
    code = at(2) - 11000
    return spread.select("sig", F.col("k").cast("long").alias("k"), (at(0) / 100).alias("onset"), ((at(1) - 10000) / 100).alias("dur"), F.pmod(code, F.lit(128)).cast("long").alias("pitch"), F.floor(code / 128).cast("long").alias("instrument"))


def donor_match(notes: DataFrame, start: float, end: float, preferred: float = 0.3) -> DataFrame:
    """(sig, k, pitch, donor_k, shift): for each note inside [start, end) the donor outside it.

    The same pitch wins, its duration nearest to the preferred one; otherwise the nearest pitch; ties go to the first
    donor. The library is first reduced to one donor per pitch, so a target meets at most 128 rows.
    """
    inside = (F.col("onset") >= start) & (F.col("onset") < end)
    return match_donors(notes.where(inside), notes.where(~inside), preferred).select("sig", "k", "pitch", "donor_k", "shift")


def match_donors(targets: DataFrame, lib: DataFrame, preferred: float = 0.3) -> DataFrame:
    """``targets`` (sig, k, pitch and others) with donor_k and shift, of a library (sig, k, pitch, dur); see :func:`donor_match`."""
    order = F.struct(F.round(F.abs(F.col("dur") - preferred), 9), "k")
    best = lib.groupBy("sig", "pitch").agg(F.min_by("k", order).alias("exact"), F.min("k").alias("first"))
    cards = best.groupBy("sig").agg(F.collect_list(F.struct("pitch", "exact", "first")).alias("lib"))
    rank = lambda x: F.struct(F.abs(x.pitch - F.col("pitch")).alias("d"), F.when(x.pitch == F.col("pitch"), x.exact).otherwise(x["first"]).alias("k"), x.pitch.alias("p"))
    got = targets.join(cards, "sig").withColumn("best", F.array_min(F.transform("lib", rank)))
    return got.withColumns({"donor_k": F.col("best.k"), "shift": F.col("pitch") - F.col("best.p")}).drop("best", "lib")


def splice_events(notes: DataFrame, patch: DataFrame, start: float, end: float) -> DataFrame:
    """Events before and after [start, end) with the patch's events between."""
    outside = notes.where((F.col("onset") < start) | (F.col("onset") >= end))
    return outside.unionByName(patch)


def chroma(notes: DataFrame, seconds: float) -> DataFrame:
    """(sig, pc, beat, n): notes per pitch class and beat up to the end of the last note; the last beat takes what lies past it."""
    n = notes.groupBy("sig").agg(F.greatest(F.lit(1), F.ceil(F.max(F.col("onset") + F.col("dur")) / seconds)).cast("long").alias("beats"))
    placed = notes.join(n, "sig").select("sig", (F.col("pitch") % 12).alias("pc"), F.least(F.floor(F.col("onset") / seconds), F.col("beats") - 1).cast("long").alias("beat"))
    return placed.groupBy("sig", "pc", "beat").agg(F.count("*").alias("n"))


def chunk_spans(signals: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(sig, c, start, stop, n): chunks a step apart; a trailing one no longer than the overlap joins the one before."""
    step = chunk - min(overlap, chunk // 2)
    overlap = min(overlap, chunk // 2)
    s = signals.where("n > 0").select("sig", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("start"))
    s = s.withColumn("stop", F.least(F.col("start") + chunk, F.col("n")))
    s = s.where((F.col("start") == 0) | (F.col("start") + overlap < F.col("n")))
    order = Window.partitionBy("sig").orderBy("start")
    s = s.withColumns({"c": (F.row_number().over(order) - 1).cast("long"), "last": F.lead("start").over(order).isNull()})
    return s.select("sig", "c", "start", F.when(F.col("last"), F.col("n")).otherwise(F.col("stop")).alias("stop"), "n")


def ramp_angle(d, width):
    """From 0 at the first of ``width`` samples to a right angle at the last one; 0 for a single sample."""
    return F.pi() / 2 * F.coalesce(d / F.nullif(width - 1, F.lit(0)), F.lit(0.0))


def taper(i, start, stop, n, fade: int):
    """sin^2 ramps, from exactly 0 to exactly 1, at the sides of a chunk that have a neighbour."""
    width = F.least(F.lit(fade).cast("long"), F.floor((stop - start) / 2).cast("long"))
    rise = lambda d: F.pow(F.sin(ramp_angle(d, width)), 2)
    left = F.when((start > 0) & (i - start < width), rise(i - start)).otherwise(1.0)
    right = F.when((stop < n) & (stop - 1 - i < width), rise(stop - 1 - i)).otherwise(1.0)
    return left * right


def overlap_add(s: DataFrame, spans: DataFrame, overlap: int, gain) -> DataFrame:
    """(sig, i, y): each chunk passed through ``gain`` (a column function), tapered, summed and divided by the weights."""
    each = spans.select("sig", "start", "stop", "n", F.explode(F.sequence("start", F.col("stop") - 1)).alias("i")).join(s, ["sig", "i"])
    each = each.withColumn("w", taper(F.col("i"), F.col("start"), F.col("stop"), F.col("n"), overlap))
    g = each.groupBy("sig", "i").agg(F.sum(gain(F.col("x")) * F.col("w")).alias("y"), F.sum("w").alias("w"), F.first("x").alias("x"))
    return g.select("sig", "i", F.when(F.col("w") > 1e-6, F.col("y") / F.col("w")).otherwise(F.col("x")).alias("y"))


def process_chunks(signals: DataFrame, load, chunk: int, overlap: int) -> DataFrame:
    """(sig, i, y): arrays (sig, x) cut into chunks, each through a model, tapered, summed and divided by the weights.

    ``load()`` runs once a partition and returns ``f(x) -> y``. Chunks are rows of their own, so one long signal spreads over
    tasks. What a model returns too long is cut, what it returns too short its own input fills up.
    """
    spans = chunk_spans(signals.select("sig", F.size("x").cast("long").alias("n")), chunk, overlap)
    pieces = spans.join(signals, "sig").select("sig", "start", "stop", "n", F.slice("x", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("x"))

    def run(parts):
        model = load()
        for part in parts:
            out = []
            for x in part.x:
                y = np.asarray(model(np.asarray(x, float)), float)[: len(x)]
                out.append(np.concatenate((y, x[len(y) :])).tolist())
            yield part[["sig", "start", "stop", "n"]].assign(y=out)

    done = pieces.repartition("sig", "start").mapInPandas(run, "sig long, start long, stop long, n long, y array<double>")
    rows = done.select("sig", "start", "stop", "n", F.posexplode("y").alias("j", "y")).withColumn("i", F.col("start") + F.col("j"))
    rows = rows.withColumn("w", taper(F.col("i"), F.col("start"), F.col("stop"), F.col("n"), min(overlap, chunk // 2)))
    g = rows.groupBy("sig", "i").agg(F.sum(F.col("y") * F.col("w")).alias("y"), F.sum("w").alias("w"), F.first("y").alias("plain"))
    return g.select("sig", "i", F.when(F.col("w") > 1e-6, F.col("y") / F.col("w")).otherwise(F.col("plain")).alias("y"))


def crossfade(s: DataFrame, patch: DataFrame, start: int, length: int, fade: int) -> DataFrame:
    """(sig, i, y): the first ``length`` samples of the patch (sig, j, p) put in at ``start`` with equal-power fades at both seams.

    The patch is cut where the signal ends, and its fades are no longer than half of what is left.
    """
    room = s.groupBy("sig").agg((F.max("i") + 1 - start).alias("room"))
    long = patch.where(F.col("j") < length).groupBy("sig").agg((F.max("j") + 1).alias("long"))
    size = room.join(long, "sig").select("sig", F.least("room", "long").cast("long").alias("long")).where("long > 0")
    p = patch.join(size, "sig").where(F.col("j") < F.col("long")).select("sig", (F.col("j") + start).alias("i"), "p", "j", "long")
    width = F.least(F.lit(fade).cast("long"), F.expr("long div 2"))
    d_out = F.col("long") - 1 - F.col("j")
    # Of a fade of one sample the first seam is all signal, the last one all patch.
    angle = F.when(F.col("j") < width, ramp_angle(F.col("j"), width)).when((d_out < width) & (width > 1), ramp_angle(d_out, width)).otherwise(F.pi() / 2)
    mixed = F.col("x") * F.cos(angle) + F.col("p") * F.sin(angle)
    return s.join(p.withColumn("mix", F.lit(True)), ["sig", "i"], "left").select("sig", "i", F.when(F.col("mix"), mixed).otherwise(F.col("x")).alias("y"))


def stage_gain(s: DataFrame, top: float = 0.5) -> DataFrame:
    """``s`` with x brought down so that no signal's peak is over ``top``, and the ``gain`` that did it."""
    peak = s.groupBy("sig").agg(F.max(F.abs("x")).alias("__peak"))
    gain = F.when(F.col("__peak") > top, top / F.col("__peak")).otherwise(1.0)
    return s.join(peak, "sig").withColumn("gain", gain).withColumn("x", F.col("x") * F.col("gain")).drop("__peak")


def unstage_gain(s: DataFrame) -> DataFrame:
    """The levels before :func:`stage_gain`."""
    return s.withColumn("x", F.col("x") / F.col("gain")).drop("gain")


def limit_peak(s: DataFrame, top: float = 1.0, to: float = 0.95) -> DataFrame:
    """(sig, k, y): signals whose peak is over ``top`` scaled so that it is ``to``; others unchanged."""
    peak = s.groupBy("sig").agg(F.max(F.abs("x")).alias("peak"))
    return s.select("sig", "k", "x").join(peak, "sig").select("sig", "k", F.when(F.col("peak") > top, F.col("x") * to / F.col("peak")).otherwise(F.col("x")).alias("y"))


def canonical(name):
    return F.regexp_replace(name, f"({'|'.join(SUFFIXES)})$", "")


def pair_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b): names with one canonical form, the last in order of each side."""
    side = lambda d, n: d.select(canonical(F.col("name")).alias("key"), "name").groupBy("key").agg(F.max("name").alias(n))
    return side(a, "a").join(side(b, "b"), "key")


def unpaired_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, side): canonical names that only one side has."""
    x, y = (d.select(canonical(F.col("name")).alias("key")).distinct() for d in (a, b))
    return x.join(y, "key", "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, "key", "left_anti").withColumn("side", F.lit("b")))


def rank_references(stems: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """(name, pos, kw, n_beats): stems that contain a keyword, ranked by keyword and then by their own order.

    A stem that is alone needs no keyword; no row means that none can serve as reference.
    """
    kw = F.least(*(F.when(F.lower("name").contains(k), F.lit(i)).otherwise(F.lit(len(keywords))) for i, k in enumerate(keywords)))
    alone = stems.agg((F.count("*") == 1).alias("alone"))
    return stems.withColumn("kw", kw).join(F.broadcast(alone)).where((F.col("kw") < len(keywords)) | F.col("alone")).drop("alone")


def fallback_reference(ranked: DataFrame, least: int = 4) -> DataFrame:
    """(name, kw, pos): the first ranked stem with enough beats; no row's values without one."""
    order = F.struct("kw", "pos")
    best = ranked.where(F.col("n_beats") >= least).agg(F.min(order).alias("o"), F.min_by("name", order).alias("name"))
    return best.select("name", F.col("o.kw").cast("long").alias("kw"), F.col("o.pos").alias("pos"))
