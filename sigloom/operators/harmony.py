"""Pitch classes, keys and phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The published probe-tone ratings of the twelve pitch classes over a major and a minor tonic.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def key_of(notes: DataFrame) -> DataFrame:
    """(sig, key, score): the key whose profile correlates best with the notes' durations by pitch class.

    Ties go to the lower tonic, major first. Signals whose classes all last equally long have no key.
    """
    pc = F.pmod("pitch", F.lit(12))
    weights = F.array(*(F.sum(F.when(pc == k, F.col("dur")).otherwise(0.0)) for k in range(12)))
    g = notes.groupBy("sig").agg(weights.alias("w"))
    mean = F.aggregate("w", F.lit(0.0), lambda s, x: s + x) / 12
    g = g.select("sig", F.transform("w", lambda x: x - mean).alias("w"))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x))
    scored = []
    for tonic, name in enumerate(NAMES):
        for mode, profile in (("major", MAJOR), ("minor", MINOR)):
            centre = sum(profile) / 12
            turned = [profile[(k - tonic) % 12] - centre for k in range(12)]
            size = sum(x * x for x in turned) ** 0.5
            dot = sum((F.get("w", F.lit(k)) * x for k, x in enumerate(turned)), F.lit(0.0))
            score = F.round(dot / (norm * size), 9)
            scored.append(F.struct((-score).alias("s"), F.lit(len(scored)).alias("n"), F.lit(f"{name} {mode}").alias("key")))
    best = g.where(norm > 1e-9).select("sig", F.array_min(F.array(*scored)).alias("b"))
    return best.select("sig", F.col("b.key").alias("key"), (-F.col("b.s")).alias("score"))


def normalize_columns(m: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``m`` with ``value`` divided by the L2 norm of its column (rows that agree in ``keys``) plus 1e-9."""
    total = F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(*keys))
    return m.withColumn(value, F.col(value) / (F.sqrt(total) + 1e-9))


def wrap(angle):
    """An angle brought into -pi to pi, half turns rounded to even."""
    return angle - 2 * F.pi() * F.rint(angle / (2 * F.pi()))


def phase_advance(spec: DataFrame, hop: int, n: int) -> DataFrame:
    """Adds ``advance`` to (stem, frame, bin, phase): the phase's step to the stem's next frame, around what the bin's
    frequency expects over ``hop`` samples. The last frame is followed by itself."""
    order = Window.partitionBy("stem", "bin").orderBy("frame")
    expected = 2 * F.pi() * hop * F.col("bin") / n
    step = F.lead("phase", 1).over(order)
    return spec.withColumn("advance", expected + wrap(F.coalesce(step, F.col("phase")) - F.col("phase") - expected))


def accumulate_phase(spec: DataFrame) -> DataFrame:
    """Adds ``total``: the first phase of each bin plus the advances before this frame, wrapped."""
    order = Window.partitionBy("stem", "bin").orderBy("frame")
    before = F.coalesce(F.sum("advance").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    first = F.first("phase").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spec.withColumn("total", wrap(first + before))


def nearest_peak(spec: DataFrame) -> DataFrame:
    """Adds ``peak``: the nearest bin of the frame whose magnitude is no less than both neighbours', the lower on ties."""
    order = Window.partitionBy("stem", "frame").orderBy("bin")
    top = (F.col("mag") >= F.coalesce(F.lag("mag").over(order), F.lit(-1.0))) & (F.col("mag") >= F.coalesce(F.lead("mag").over(order), F.lit(-1.0)))
    s = spec.withColumn("p", F.when(top, F.col("bin")))
    below = F.last("p", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("p", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumns({"lo": below, "hi": above})
    pick = F.when(F.col("hi").isNull() | (F.col("bin") - F.col("lo") <= F.col("hi") - F.col("bin")), F.col("lo")).otherwise(F.col("hi"))
    return s.withColumn("peak", pick).drop("p", "lo", "hi")
