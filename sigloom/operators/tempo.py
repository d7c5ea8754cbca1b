"""Tempo correction of songs: one beat grid and one warp map for all stems of a song."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators import timing, warp

#: Beats that a reference needs.
LEAST_BEATS = 4


def pick_references(stems: DataFrame, beats: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """(song, reference): the first stem of a song by keyword, then by place, that has LEAST_BEATS beats; a lone stem needs no keyword.

    stems (song, name, pos), beats (song, name, t). A song without such a stem has no row.
    """
    known = stems.select("song", "name", "pos").distinct()
    kw = F.array_min(F.array(*(F.when(F.lower("name").contains(k), F.lit(i)).otherwise(F.lit(len(keywords))) for i, k in enumerate(keywords)), F.lit(len(keywords))))
    alone = F.count("*").over(Window.partitionBy("song")) == 1
    ranked = known.withColumns({"kw": kw, "alone": alone}).where((F.col("kw") < len(keywords)) | F.col("alone"))
    enough = beats.groupBy("song", "name").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_BEATS)
    return ranked.join(enough, ["song", "name"]).groupBy("song").agg(F.min_by("name", F.struct("kw", "pos")).alias("reference"))


def correct_tempo(stems: DataFrame, beats: DataFrame, sr: int, keywords: tuple[str, ...], n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """(song, name, ch, y, reference, status): every stem read through the map of its song's reference.

    stems (song, name, pos, ch, x array). All stems of a song share one grid and so stay together, and the channels of a stem one
    rotation of their spectra, so that its stereo image stays (see :mod:`warp`). status: corrected, even (the map is the identity
    or the stem is shorter than a frame: samples unchanged) or no reference (samples unchanged, reference null).
    """
    picked = pick_references(stems, beats, keywords)
    every = stems.withColumn("sig", F.xxhash64("song", "name")).join(picked, "song", "left")
    led = every.where("reference is not null")
    sizes = led.groupBy("sig", "song", "reference").agg(F.min(F.size("x")).cast("long").alias("n"))
    grid = sizes.join(beats.withColumnRenamed("name", "reference"), ["song", "reference"]).select("sig", "t")
    anchors = timing.warp_anchors(grid, sr, sizes.select("sig", "n"))
    warped = warp.warp_arrays(led.select("sig", "ch", "x"), anchors, n_fft, hop)
    status = F.when(F.col("reference").isNull(), "no reference").when(F.col("y").isNotNull(), "corrected").otherwise("even")
    return every.join(warped, ["sig", "ch"], "left").select("song", "name", "ch", F.coalesce("y", "x").alias("y"), "reference", status.alias("status"))
