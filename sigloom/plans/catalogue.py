"""The registered queries, each an operator over one of the table models, and the SQL that must agree with it."""

from __future__ import annotations

import math
import uuid
from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.functions.numeric import r, rms_db, setting_flag, setting_number, setting_text, setting_whole
from sigloom.operators import blocks, compare, events, harmony, kernels, layout, levels, pitch, repair, report, runs, spectral, stages, tempo, timing
from sigloom.plans import sql
from sigloom.sources import audio, interim, tables, wav

FLAGSHIP = "compare"
SR, N = 48_000, 64
#: Samples a second of beat signals, and the frame sizes of the dense signal.
BEAT_SR, FRAME, HOP, BLOCK = 100, 400, 100, 50
#: Rate and measures of the signals that are compared as a whole, and how late one of a pair is.
PLAY_SR, LATE = 4000, 37
PLAY_SIZES = compare.Sizes(coarse_s=0.25, fine_s=0.02, material_s=1.0, window_s=0.25, hop_s=0.125, search_s=0.03, n_fft=256, hop=64, coherence=512, hf_low=1000.0, hf_high=2000.0, least_s=0.1)


def rounded(df, *places):
    """Doubles to six places (or as given by name=places pairs), other columns as they are."""
    given = dict(places)
    return df.select(*(r(F.col(c), given.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def damaged(s, column="x"):
    """a, and b with a known damage: 2 dB down, users divisible by 7 untouched, by 5 with loud samples clipped lower."""
    gain = F.lit(10 ** (-2 / 20))
    b = F.when(F.col("sig") % 7 == 0, F.col(column)).when((F.col("sig") % 5 == 0) & (F.col(column) > 0.6), F.lit(0.6)).otherwise(F.col(column) * gain)
    return s.withColumns({"a": F.col(column), "b": b})


def spectrum(spark, d):
    return spectral.dft(tables.frames(spark, d), N, SR)


def cut_band(spec):
    """The spectrum with 5 to 10 kHz down 3 dB and everything down 2 dB."""
    down = F.when((F.col("hz") >= 5000) & (F.col("hz") < 10000), 10 ** (-5 / 20)).otherwise(10 ** (-2 / 20))
    return spec.withColumn("mag", F.col("mag") * down)


def two_sided(spec):
    """mag, and mb as :func:`cut_band` changes it."""
    return cut_band(spec.withColumn("old", F.col("mag"))).withColumnsRenamed({"mag": "mb", "old": "mag"})


def lengths(b, sr):
    return b.groupBy("sig").agg((F.floor(F.max("t") * sr) + 1).cast("long").alias("n"))


def anchors(spark, d):
    b = tables.beats(spark, d).select("sig", "t")
    return timing.warp_anchors(b, BEAT_SR, lengths(b, BEAT_SR))


def dense_levels(spark, d):
    s = tables.dense(spark, d)
    return levels.frame_power(s, FRAME, HOP, last=True)


def arrays(spark, d, least=0):
    return tables.frames(spark, d).select(F.col("frame").alias("sig"), "x")


def stems(spark, d):
    """Names with their order and a number of beats."""
    p = tables.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"), F.max("p_size").alias("n_beats"))
    return p.select("name", "pos", (F.col("n_beats") % 9).cast("long").alias("n_beats"))


def suffixed(names):
    """Every other name (by length) with a suffix, and one name that stands alone."""
    return names.where(F.length("name") % 2 == 0).select(F.concat("name", F.lit("_restored")).alias("name")).unionByName(names.sparkSession.range(1).select(F.lit("only here_dry").alias("name")))


def report_pairs(spark, d):
    return damaged(tables.beats(spark, d)).select("sig", "k", "t", "a", "b")


def q_tempo(spark, d):
    return rounded(timing.tempo_stability(tables.beats(spark, d)))


def q_anchors(spark, d):
    return anchors(spark, d)


def q_warp(spark, d):
    return rounded(timing.describe_warp(anchors(spark, d)))


def q_read_warp(spark, d):
    grid = anchors(spark, d).groupBy("sig").agg(F.max("dst").alias("m")).select("sig", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("j"), "m")
    return rounded(timing.read_warp(anchors(spark, d), grid.select("sig", F.expr("(m * j) div 8").alias("dst"))).distinct(), ("src", 4))


def q_info(spark, d):
    return rounded(levels.signal_info(tables.beats(spark, d)))


def q_silence(spark, d):
    s = tables.beats(spark, d).withColumn("x", F.when(F.col("sig") % 3 == 0, F.col("x") * 0.001).otherwise(F.col("x")))
    return levels.silence(s)


def q_residual(spark, d):
    return rounded(levels.residual(damaged(tables.beats(spark, d))).drop("bucket"))


def q_bucket(spark, d):
    return levels.residual(damaged(tables.beats(spark, d))).drop("level")


def q_frames(spark, d):
    return rounded(levels.frame_power(tables.dense(spark, d), FRAME, HOP, last=False), ("power", 9))


def q_envelope(spark, d):
    return rounded(levels.envelope(tables.dense(spark, d), BLOCK))


def q_dft(spark, d):
    return rounded(spectrum(spark, d).select("frame", "bin", "mag"))


def q_p95(spark, d):
    return rounded(spectral.percentile_spectrum(spectrum(spark, d)).select("stem", "bin", "amp", "level"))


def q_cliff(spark, d):
    return rounded(spectral.spectral_cliff(spectral.percentile_spectrum(cut_band(spectrum(spark, d))), 2, 1500.0, 0.5))


def q_above(spark, d):
    return rounded(spectral.energy_above(spectral.percentile_spectrum(spectrum(spark, d)), 13_000.0))


def q_bands(spark, d):
    return rounded(spectral.band_delta(two_sided(spectrum(spark, d)), SR / 2))


def q_features(spark, d):
    return rounded(spectral.features(spectrum(spark, d)).drop("stem"), ("rolloff85", 3), ("rolloff99", 3))


def q_hf(spark, d):
    return rounded(spectral.hf_envelope_correlation(two_sided(spectrum(spark, d)), 10_000.0))


def q_modulation(spark, d):
    return rounded(spectral.modulation(tables.beats(spark, d).select("sig", "k", "x"), sql.LEVEL_RATE))


def q_risk(spark, d):
    return rounded(timing.risk_region(tables.beats(spark, d), 0.5))


def q_gain(spark, d):
    s = damaged(tables.dense(spark, d).withColumn("x", F.col("x") * F.pow(F.lit(10.0), -(F.col("i") % 4000) / 1000.0)).withColumn("sig", F.lit(1).cast("long")))
    hop = F.expr(f"i div {BLOCK}")
    f = s.groupBy("sig", hop.alias("f")).agg(F.avg(F.col("a") * F.col("a")).alias("pa"), F.avg(F.col("b") * F.col("b")).alias("pb"))
    lv = f.select("sig", rms_db(F.col("pa")).alias("da"), rms_db(F.col("pb")).alias("db"))
    return rounded(report.gain_curve(lv))


def q_stereo(spark, d):
    return rounded(spectral.stereo_metrics(tables.stereo(spark, d)))


def q_midside(spark, d):
    lr = tables.stereo(spark, d)
    back = spectral.from_mid_side(spectral.to_mid_side(lr))
    both = lr.join(back.select("pair", "i", F.col("l").alias("bl"), F.col("r").alias("br")), ["pair", "i"])
    return rounded(both.groupBy("pair").agg(F.max(F.greatest(F.abs(F.col("l") - F.col("bl")), F.abs(F.col("r") - F.col("br")))).alias("error"), F.count("*").alias("n")))


def q_mono(spark, d):
    lr = tables.stereo(spark, d)
    return rounded(lr.select("pair", "i", ((F.col("l") + F.col("r")) / 2).alias("mono")))


def q_bars(spark, d):
    return rounded(levels.peak_bars(tables.beats(spark, d), 20))


def q_loudness(spark, d):
    return rounded(levels.integrated_loudness(dense_levels(spark, d)))


def q_range(spark, d):
    return rounded(levels.loudness_range(dense_levels(spark, d)))


def q_step(spark, d):
    return rounded(levels.max_step(tables.beats(spark, d)))


def q_loudest(spark, d):
    return rounded(levels.loudest_start(tables.dense(spark, d), 8, HOP), ("power", 9))


def q_lag(spark, d):
    return rounded(timing.best_lag(tables.stereo(spark, d), 8))


def q_sliding(spark, d):
    return rounded(timing.sliding_correlation(tables.stereo(spark, d), 16))


def q_summary(spark, d):
    return rounded(timing.correlation_summary(timing.sliding_correlation(tables.stereo(spark, d), 16)))


def q_fine(spark, d):
    return rounded(report.local_fine(damaged(tables.beats(spark, d)), 8))


def q_donor(spark, d):
    return events.donor_match(tables.notes(spark, d), *sql.REGION)


def q_splice(spark, d):
    n = tables.notes(spark, d)
    patch = n.where((F.col("onset") >= sql.REGION[0]) & (F.col("onset") < sql.REGION[1])).withColumn("pitch", (F.col("pitch") + 1) % 128)
    return rounded(events.splice_events(n, patch, *sql.REGION))


def q_chroma(spark, d):
    return events.chroma(tables.notes(spark, d), sql.BEAT_SECONDS)


def q_decode(spark, d):
    return rounded(events.decode_notes(events.encode_notes(tables.notes(spark, d))))


def q_spans(spark, d):
    n = tables.beats(spark, d).groupBy("sig").agg(F.count("*").alias("n"))
    return events.chunk_spans(n, *sql.CHUNK).drop("n")


def q_overlap(spark, d):
    s = tables.beats(spark, d).select("sig", F.col("k").alias("i"), "x")
    n = s.groupBy("sig").agg(F.count("*").alias("n"))
    return rounded(events.overlap_add(s, events.chunk_spans(n, *sql.CHUNK), sql.CHUNK[1], lambda x: x * 0.5))


def q_crossfade(spark, d):
    s = tables.beats(spark, d).select("sig", F.col("k").alias("i"), "x")
    return rounded(events.crossfade(s, s.select("sig", F.col("i").alias("j"), (F.lit(1.0) - F.col("x")).alias("p")), *sql.SPLICE))


def q_limit(spark, d):
    s = tables.beats(spark, d).withColumn("x", F.when(F.col("sig") % 2 == 0, F.col("x") * 1.5).otherwise(F.col("x")))
    return rounded(events.limit_peak(s))


def q_staging(spark, d):
    s = events.stage_gain(tables.beats(spark, d).select("sig", "x"))
    return rounded(s.groupBy("sig").agg(F.max("gain").alias("gain"), F.max(F.abs("x")).alias("staged_peak")))


def q_rank(spark, d):
    x = events.rank_references(stems(spark, d), sql.KEYWORDS)
    return x.select("name", F.col("kw").cast("long").alias("kw"), "pos")


def q_fallback(spark, d):
    return events.fallback_reference(events.rank_references(stems(spark, d), sql.KEYWORDS))


def q_pairs(spark, d):
    n = stems(spark, d).select("name")
    return events.pair_names(n, suffixed(n))


def q_unpaired(spark, d):
    n = stems(spark, d).select("name")
    return events.unpaired_names(n, suffixed(n))


def q_transients(spark, d):
    s = damaged(tables.dense(spark, d).withColumn("sig", F.lit(1).cast("long")))
    on = s.where((F.col("a") > 0.85) & (F.col("i") >= 40)).select("sig", F.col("i").alias("o"))
    return rounded(report.transients(s, on, 25, 5, 30))


def q_report(spark, d):
    return rounded(report.quality_report(report_pairs(spark, d), 8, *sql.SHORT_FRAME))


def short_spectrum(ab):
    """Spectra of both sides of a pair beside each other, in frames of 16 samples."""
    f = ab.groupBy("sig", F.expr("k div 16").alias("frame")).agg(F.sort_array(F.collect_list(F.struct("k", "a", "b"))).alias("v"))
    return spectral.dft(f.select(F.col("sig").alias("stem"), "frame", F.col("v.a").alias("x"), F.col("v.b").alias("y")), 16, SR, second="y")


def q_verdict(spark, d):
    ab = report_pairs(spark, d)
    cut = (F.col("sig") % 13 == 0) & F.lead("k").over(Window.partitionBy("sig").orderBy("k")).isNull()
    ends = ab.withColumn("tb", F.when(~cut, F.col("t"))).groupBy("sig").agg(F.max("t").alias("end_a"), F.max("tb").alias("end_b"))
    ends = ends.withColumns({"channels_a": F.lit(1), "channels_b": F.when(F.col("sig") % 11 == 0, 2).otherwise(1)})
    late = ab.select("sig", F.col("k").alias("w"), F.when(F.col("sig") % 17 == 0, F.col("k") * 0.2).otherwise(0.0).alias("ms"))
    bands = spectral.band_delta(short_spectrum(ab), SR / 2).withColumnRenamed("stem", "sig")
    onsets = ab.where("a > 0.85 and k >= 6").select("sig", F.col("k").alias("o"))
    slopes = report.transients(ab.select("sig", F.col("k").alias("i"), "a", "b"), onsets, 5, 1, 6)
    return report.verdict(report.with_measures(report.quality_report(ab, 8, *sql.SHORT_FRAME), ends, late, bands, slopes))


def q_batch(spark, d):
    return report.batch_verdict(q_verdict(spark, d))


def q_offset(spark, d):
    a = tables.dense(spark, d)
    return rounded(timing.estimate_offset(a, a.withColumn("i", F.col("i") + sql.DELAY), BLOCK, 10, 60, 8))


def q_key(spark, d):
    return rounded(harmony.key_of(tables.notes(spark, d)))


def q_columns(spark, d):
    m = events.chroma(tables.notes(spark, d), sql.BEAT_SECONDS).withColumn("n", F.col("n").cast("double"))
    return rounded(harmony.normalize_columns(m, ["sig", "beat"], "n"))


def q_phase(spark, d):
    s = spectral.dft(tables.frames(spark, d), N, SR, phase=True)
    p = harmony.accumulate_phase(harmony.phase_advance(s, 16, N))
    return rounded(p.select("stem", "frame", "bin", F.cos("advance").alias("step"), F.cos("total").alias("re"), F.sin("total").alias("im")), ("re", 5), ("im", 5))


def q_peaks(spark, d):
    return harmony.nearest_peak(spectrum(spark, d)).select("frame", "bin", "peak")


def channel_rows(spark, d):
    """The stereo pairs, a row a channel and sample."""
    both = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("ch"), F.col("l").alias("x")), F.struct(F.lit(1).cast("long").alias("ch"), F.col("r").alias("x"))))
    return tables.stereo(spark, d).select(F.col("pair").alias("sig"), "i", both.alias("v")).select("sig", "v.ch", "i", "v.x")


def q_match(spark, d):
    return rounded(layout.match_channels(channel_rows(spark, d), 3))


def q_delta(spark, d):
    change = tables.stereo(spark, d).where("pair % 2 = 0 and i < 40").select(F.col("pair").alias("sig"), "i", (8 * F.col("l")).alias("d"))
    return rounded(layout.apply_delta(channel_rows(spark, d), change))


def q_integrity(spark, d):
    before = channel_rows(spark, d).groupBy("sig").agg((F.max("ch") + 1).alias("channels"))
    after = before.where("sig % 5 <> 0").withColumn("channels", F.when(F.col("sig") % 7 == 0, 1).otherwise(F.col("channels")))
    return layout.check_stage(before, after)


def q_stem_sum(spark, d):
    mix = tables.stereo(spark, d).select(F.col("pair").alias("sig"), "i", (F.col("l") + 0.9 * F.col("r")).alias("m"))
    return rounded(layout.stem_summary(channel_rows(spark, d).withColumnRenamed("ch", "stem"), mix))


def q_rollback(spark, d):
    b = tables.beats(spark, d)
    region = timing.risk_region(b, 0.5).select("sig", "start", "end")
    repaired = b.withColumn("x", F.col("x") * F.when(F.col("sig") % 2 == 0, 0.8).otherwise(1.1))
    return rounded(layout.keep_if_better(layout.masked_mean(b, region, 0.5, "x"), layout.masked_mean(repaired, region, 0.5, "x")))


def q_labels(spark, d):
    p = tables.table(spark, d, "part")
    hz = (F.col("p_size") % 7) * F.col("p_size") * 100
    found = p.select("p_partkey", layout.hz_label(hz).alias("cutoff"), layout.output_rate(F.lit(48_000), (F.col("p_size") % 3) * 22_050).cast("long").alias("rate"), layout.target_bpm(F.col("p_size") / 10).alias("bpm"), layout.percent_label(F.when(F.col("p_size") % 5 > 0, F.col("p_size") / 7)).alias("share"))
    return rounded(found)


def q_track(spark, d):
    s = tables.beats(spark, d).select("sig", F.col("k").alias("i"), F.col("x").alias("a"))
    late = s.select("sig", (F.col("i") + 2).alias("i"), F.col("a").alias("b"))
    return rounded(kernels.track_offsets(s.join(late, ["sig", "i"], "left"), *sql.TRACK))


def q_k_weight(spark, d):
    found = kernels.k_weight(arrays(spark, d), SR)
    return rounded(found.select("sig", F.posexplode("y").alias("i", "y")))


def q_k_loudness(spark, d):
    """Two vectors are the channels of a signal; blocks of 32 samples, 8 apart."""
    f = tables.frames(spark, d).select(F.expr("frame div 2").alias("sig"), (F.col("frame") % 2).alias("ch"), "x")
    return rounded(levels.integrated_loudness(kernels.block_power(f, SR, *sql.LOUD_BLOCK)))


def q_describe(spark, d):
    f = tables.frames(spark, d).select(F.expr("frame div 2").alias("sig"), (F.col("frame") % 2).alias("ch"), "x")
    rows = f.select("sig", "ch", F.posexplode("x").alias("i", "x"))
    short, long = (kernels.block_power(f, SR, *size) for size in (sql.LOUD_BLOCK, sql.RANGE_BLOCK))
    return rounded(levels.describe(rows, short, long, SR).drop("rate"))


def q_wav(spark, d):
    """Stereo pairs through 24-bit WAV images, a row a sample that comes back."""
    import numpy as np

    f = tables.frames(spark, d).select(F.expr("frame div 2").alias("sig"), (F.col("frame") % 2).alias("ch"), "x")
    pairs = f.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("ch", "x"))).alias("v")).select("sig", F.col("v.x").alias("x"))

    def through(parts):
        import pandas as pd

        for part in parts:
            images = [audio.render_wav(np.stack([np.asarray(c, float) for c in x], 1), SR) for x in part.x]
            yield pd.DataFrame({"sig": part.sig, "y": [[c.astype(float).tolist() for c in audio.parse_wav(w)[1].T] for w in images]})

    back = pairs.mapInPandas(through, "sig long, y array<array<double>>").select("sig", F.posexplode("y").alias("ch", "y"))
    return rounded(back.select("sig", F.col("ch").cast("long").alias("ch"), F.posexplode("y").alias("i", "x")))


def q_chunks(spark, d):
    """Long signals through a stand-in model in chunks; it returns three samples too few."""
    s = tables.beats(spark, d).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).select("sig", F.col("v.x").alias("x"))
    return rounded(events.process_chunks(s, short_model, *sql.CHUNK))


def short_model():
    return lambda x: x[:-3] * 0.5 if len(x) > 3 else x[:0]


def q_resample(spark, d):
    found = kernels.resample(arrays(spark, d), 48_000, 44_100)
    return rounded(found.select("sig", F.posexplode("y").alias("i", "y")))


def q_dtw(spark, d):
    a = arrays(spark, d)
    b = a.select((F.col("sig") - 1).alias("sig"), F.col("x").alias("y")).where("sig % 2 = 0")
    return rounded(pitch.chroma_distance(a.join(b, "sig"), 1))


def q_coherence(spark, d):
    f = tables.frames(spark, d)
    other = F.transform("x", lambda v, i: v + 0.05 * F.sin(i * 1.0))
    return rounded(kernels.coherence(f.select(F.col("stem").alias("sig"), "frame", "x", other.alias("y")), N, 8))


def q_scaled(spark, d):
    s = tables.beats(spark, d)
    ref = s.withColumn("x", F.when(F.col("sig") % 4 == 0, F.lit(0.0)).otherwise(F.col("x") * 0.5))
    return rounded(levels.scaled_to(s.select("sig", "k", "x"), ref))


def q_settings(spark, d):
    p = tables.table(spark, d, "part")
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    raw = F.when(kind == 0, size).when(kind == 1, " ").when(kind == 2, " Yes").when(kind == 3, "off").when(kind == 4, F.concat(F.lit(" -"), size, F.lit(".75 "))).when(kind == 5, F.concat(size, F.lit("d")))
    p = p.select("p_partkey", raw.alias("raw"))
    return p.select("p_partkey", setting_number(p.raw, 2.5).alias("number"), setting_whole(p.raw, 7).alias("whole"), setting_flag(p.raw, True).alias("flag"), setting_text(p.raw, "none").alias("words"))


def q_retry(spark, d):
    s = tables.stereo(spark, d).withColumn("g", F.when(F.col("pair") % 9 == 0, 0.001).otherwise(1.0))
    v = F.sort_array(F.collect_list(F.struct("i", (F.col("l") * F.col("g")).alias("l"), (F.col("r") * F.col("g")).alias("r"))))
    stems = s.groupBy(F.col("pair").alias("sig")).agg(v.alias("v")).select("sig", F.array("v.l", "v.r").alias("x"))
    found = stages.clean_stems(stems, mono_stand_in)
    energy = F.aggregate(F.flatten("y"), F.lit(0.0), lambda n, x: n + x * x)
    return rounded(found.select("sig", "strategy", energy.alias("energy"), "residual"))


def mono_stand_in():
    """A model that bends loud samples and, like some denoisers, gives one channel for two."""
    return lambda x: x.mean(0) - 0.5 * x.mean(0) ** 3


def model(load, spark, d):
    return kernels.apply_model(arrays(spark, d), load).select("sig", F.size("y").alias("n"))


def stand_in():
    return lambda x: x * 0.98


def long_signals(spark, d, n):
    """(sig, ch, x array): the dense signal cut into signals of n samples, whose second channel is a bent, weaker copy."""
    s = tables.dense(spark, d).select(F.expr(f"i div {n}").alias("sig"), "i", (F.col("x") - 0.5).alias("x"))
    rows = F.sort_array(F.collect_list(F.struct("i", "x")))
    both = F.array(F.transform(rows, lambda r: r.x), F.transform(rows, lambda r: 0.6 * r.x + 0.2 * r.x * r.x))
    return s.groupBy("sig").agg(both.alias("x")).select("sig", F.posexplode("x").alias("ch", "x")).withColumn("ch", F.col("ch").cast("long"))


def q_compare(spark, d):
    """Whole signals of two seconds against themselves 2 dB down, those of odd number 37 samples late, every third one nearer to mono."""
    a = long_signals(spark, d, 2 * PLAY_SR)
    other = a.select("sig", (1 - F.col("ch")).alias("ch"), F.col("x").alias("other"))
    mixed = a.join(other, ["sig", "ch"]).withColumn("share", F.when(F.col("sig") % 3 == 0, 0.25).otherwise(0.0))
    gain = 10 ** (-2 / 20)
    b = mixed.withColumn("y", F.zip_with("x", "other", lambda x, y: gain * (x + F.col("share") * (y - x))))
    late = F.when(F.col("sig") % 2 == 1, F.concat(F.array_repeat(F.lit(0.0), LATE), F.slice("y", F.lit(1), F.greatest(F.size("y") - LATE, F.lit(0))))).otherwise(F.col("y"))
    return compare.compare(a, b.select("sig", "ch", late.alias("x")), PLAY_SR, PLAY_SIZES)


def q_correct_tempo(spark, d):
    """Songs of 5000 samples, of a drum and a bass stem, with a beat on about every 500th sample."""
    stems = long_signals(spark, d, 5000).withColumn("name", F.explode(F.array(F.lit("Drums"), F.lit("Bass"))))
    stems = stems.select(F.col("sig").alias("song"), "name", F.when(F.col("name") == "Drums", 0).otherwise(1).alias("pos"), "ch", "x")
    e = tables.dense(spark, d).where("i % 500 = 250")
    beats = e.select(F.expr("i div 5000").alias("song"), F.lit("Drums").alias("name"), ((F.col("i") % 5000 + F.round(40 * F.col("x"))) / BEAT_SR).alias("t"))
    found = tempo.correct_tempo(stems, beats, BEAT_SR, ("drums",), 128, 32)
    return found.select("song", "name", "ch", "status", F.size("y").alias("n"), F.aggregate("y", F.lit(0.0), lambda t, x: t + x * x).alias("energy"))


def q_repair(spark, d):
    """Stems of 16,384 samples, a note each quarter second, with the table's values as noise in the middle; the repair has the missing notes."""
    e = tables.dense(spark, d).select(F.expr("i div 16384").alias("sig"), (F.col("i") % 16_384).alias("i"), "x")
    second = F.col("i") / PLAY_SR
    pitch = 60 + F.floor(4 * second) % 5
    tone = 0.3 * F.sin(2 * F.pi() * 440 * F.pow(F.lit(2.0), (pitch - 69) / 12) * (second - F.floor(4 * second) / 4))
    noisy = e.withColumn("y", F.when((second >= 1.5) & (second < 2.5), F.col("x") - 0.2).otherwise(tone))
    both = F.sort_array(F.collect_list(F.struct("i", "y")))
    stems = noisy.groupBy("sig").agg(both.alias("v")).select("sig", F.posexplode(F.array(F.col("v.y"), F.transform("v.y", lambda x: 0.5 * x))).alias("ch", "x"))
    notes = e.where("i % 1000 = 0").select("sig", F.expr("i div 1000").alias("k"), second.alias("onset"), F.lit(0.25).alias("dur"), pitch.cast("long").alias("pitch"))
    found = repair.enhance(stems.withColumn("sr", F.lit(PLAY_SR)), notes, notes, PLAY_SR, 512, 128)
    return found.select("sig", F.col("ch").cast("long").alias("ch"), "status", F.size("x").alias("n"), *(F.round(c, 3).alias(c) for c in ("start", "end", "before", "after")))


def note_signals(spark, d, rate=4000):
    """(sig, x): the first sixteen notes of each user as tones of an eighth of a second, two partials each, their pitch that of the table."""
    n = tables.notes(spark, d).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("k", "pitch"))).alias("v"))
    tone = lambda p: F.transform(F.sequence(F.lit(0), F.lit(rate // 8 - 1)), lambda i: F.sin(i * (2 * math.pi / rate) * p))
    hz = lambda p: 440 * F.pow(F.lit(2.0), (48 + p % 24 - 69) / 12)
    return n.select("sig", F.flatten(F.transform(F.slice("v.pitch", 1, 16), lambda p: F.zip_with(tone(hz(p)), tone(2 * hz(p)), lambda a, b: 0.3 * a + 0.1 * b))).alias("x"))


def q_mel_onsets(spark, d):
    found = pitch.onsets(note_signals(spark, d), 4000, 256, 64)
    return found.select("sig", F.posexplode("y").alias("k", "o"))


def q_chroma_distance(spark, d):
    """The chroma of each user's tune against that of the next user's."""
    v = pitch.chroma(note_signals(spark, d), 4000, 512)
    other = v.select((F.col("sig") - 1).alias("sig"), F.col("y").alias("z"))
    return rounded(pitch.chroma_distance(v.join(other, "sig").select("sig", F.col("y").alias("x"), F.col("z").alias("y"))))


def gentle():
    return lambda x: 0.9 * x


def q_restore(spark, d):
    """The dense signal as WAV stems of two seconds, restored: tempo, denoiser and extender are stand-ins."""
    folder = f"{interim.shared_folder(spark)}/restore-{uuid.uuid4().hex}"
    stems = long_signals(spark, d, 2 * PLAY_SR).select(F.concat(F.lit("Stem "), "sig").alias("name"), F.lit(PLAY_SR).alias("sr"), "ch", "x")
    runs.save(stems, f"{folder}/in", "", 32)
    beats = stems.where("name = 'Stem 0' and ch = 0").select("name", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k")).select("name", (F.col("k") * 0.25 + 0.01 * (F.col("k") % 2)).alias("t"))
    report, _ = runs.restore(spark, f"{folder}/in", f"{folder}/out", f"{folder}/work", beats, ("stem 0",), gentle, gentle, 512, 128, (1024, 256), 1000.0)
    return rounded(report.drop("output"))


def q_wav_source(spark, d):
    """Stereo pairs written as WAV files by the data source and read again; of a repeated vector each copy, without a partner as a mono stem."""
    f = tables.frames(spark, d).select(F.expr("frame div 2").alias("pair"), (F.col("frame") % 2).cast("int").alias("side"), "x")
    pair, stem = Window.partitionBy("pair"), Window.partitionBy("pair", "copy")
    odd, copy = F.max("side").over(pair) == 1, F.row_number().over(Window.partitionBy("pair", "side").orderBy("x"))
    whole = f.withColumns({"odd": odd, "copy": copy}).where("odd").withColumns({"channels": F.count("*").over(stem).cast("int"), "first": F.min("side").over(stem)})
    stems = whole.select(F.concat_ws("_", "pair", "copy", "first").alias("name"), F.lit(SR).alias("sr"), "channels", F.lit(64).cast("long").alias("n"), (F.col("side") - F.col("first")).alias("ch"), F.lit(0).cast("long").alias("block"), "x")
    folder = f"{interim.shared_folder(spark)}/wav-{uuid.uuid4().hex}"
    wav.write_stems(stems, folder)
    part = F.split("name", "_")
    back = wav.read_blocks(spark, folder).select(part[0].cast("long").alias("sig"), (part[2].cast("long") + F.col("ch")).alias("ch"), "i0", F.posexplode("x").alias("i", "x"))
    return rounded(back.select("sig", "ch", (F.col("i0") + F.col("i")).cast("int").alias("i"), F.col("x").cast("double").alias("x")))


def vectors(spark, d, size, ch=None):
    """The vectors as blocks, each a signal, or two of them the channels of one."""
    f = tables.frames(spark, d)
    f = f.select(F.expr("frame div 2").alias("sig"), (F.col("frame") % 2).alias("ch"), "x") if ch else f.select(F.col("frame").alias("sig"), F.lit(0).alias("ch"), "x")
    return blocks.to_blocks(f, size)


def q_block_weight(spark, d):
    found = blocks.k_weighted(vectors(spark, d, 24), SR)
    return rounded(found.select("sig", "block", F.posexplode("x").alias("j", "y")).select("sig", (F.col("block") * 24 + F.col("j")).cast("int").alias("i"), "y"))


def q_block_loudness(spark, d):
    return rounded(levels.integrated_loudness(blocks.k_weighted_power(vectors(spark, d, 24, True), SR, 24, *sql.LOUD_BLOCK)))


def beat_blocks(spark, d, size=20):
    s = tables.beats(spark, d)
    late = s.select("sig", (F.col("k") + 2).alias("k"), F.col("x").alias("b"))
    rows = F.sort_array(F.collect_list(F.struct("k", "x", "b")))
    both = s.join(late, ["sig", "k"], "left").groupBy("sig", F.expr(f"k div {size}").alias("block")).agg(rows.alias("v"))
    return both.select("sig", F.lit(0).alias("ch"), "block", F.col("v.x").alias("x"), F.col("v.x").alias("a"), F.transform("v.b", lambda v: F.coalesce(v, F.lit(0.0))).alias("b"))


def q_block_step(spark, d):
    return rounded(blocks.max_step(beat_blocks(spark, d)).select("sig", "step"))


def q_block_track(spark, d):
    return rounded(blocks.track_offsets(beat_blocks(spark, d), *sql.TRACK))


def two_sided_vectors(spark, d):
    return tables.frames(spark, d).select(F.col("frame").alias("sig"), "x", F.transform("x", lambda v, i: v + 0.05 * F.sin(i * 1.0)).alias("y"))


def q_welch(spark, d):
    return rounded(kernels.welch_coherence(two_sided_vectors(spark, d), 32, SR, 3000.0, 24_000.0))


def q_block_welch(spark, d):
    pairs = two_sided_vectors(spark, d)
    sides = [blocks.to_blocks(pairs.select("sig", F.lit(0).alias("ch"), F.col(c).alias("x")), 32).select("sig", "block", F.col("x").alias(c)) for c in "xy"]
    return rounded(blocks.coherence(sides[0].join(sides[1], ["sig", "block"]), 32, 32, SR, 3000.0, 24_000.0))


def q_fine_tracked(spark, d):
    s = tables.beats(spark, d).select("sig", F.col("k").alias("i"), F.col("x").alias("a"))
    late = s.select("sig", (F.col("i") + 2).alias("i"), F.col("a").alias("b"))
    tracked = kernels.track_offsets(s.join(late, ["sig", "i"], "left"), *sql.TRACK)
    return rounded(compare.fine_at_offsets(s, late, tracked, sql.TRACK[1], 8))


def q_both_images(spark, d):
    """The stereo image of the pairs, and of the same a quarter of the way to each other."""
    lr = tables.stereo(spark, d)
    near = lr.select("pair", "i", (0.75 * F.col("l") + 0.25 * F.col("r")).alias("l"), (0.25 * F.col("l") + 0.75 * F.col("r")).alias("r"))

    def channels(s):
        rows = F.sort_array(F.collect_list(F.struct("i", "l", "r")))
        both = s.groupBy(F.col("pair").alias("sig")).agg(rows.alias("v")).select("sig", F.posexplode(F.array("v.l", "v.r")).alias("ch", "x"))
        return both

    return rounded(compare.stereo(channels(lr), "a").join(compare.stereo(channels(near), "b"), "sig").drop("channels_a", "channels_b"))


def q_decay(spark, d):
    s = damaged(tables.dense(spark, d).withColumn("sig", F.lit(1).cast("long")))
    on = s.where((F.col("a") > 0.3) & (F.col("i") >= 40)).select("sig", F.col("i").alias("o"))
    return rounded(report.transients(s, on, 25, 5, 30, sql.TAIL))


def queries():
    return {
        "compare": q_compare, "correct_tempo": q_correct_tempo, "block_k_weight": q_block_weight, "block_loudness": q_block_loudness, "block_max_step": q_block_step,
        "block_offset_track": q_block_track, "welch_coherence": q_welch, "block_coherence": q_block_welch, "fine_at_offsets": q_fine_tracked,
        "stereo_both_sides": q_both_images, "transient_decay": q_decay, "repair_chain": q_repair, "wav_source": q_wav_source,
        "mel_onsets": q_mel_onsets, "chroma_distance": q_chroma_distance, "restore_run": q_restore,
        "tempo_stability": q_tempo, "beat_warp_anchors": q_anchors, "warp_summary": q_warp, "warp_read": q_read_warp,
        "signal_info": q_info, "silence_flags": q_silence, "residual_level": q_residual, "residual_bucket": q_bucket,
        "frame_rms_hopping": q_frames, "envelope_blocks": q_envelope, "dft_magnitude": q_dft, "spectrum_p95": q_p95,
        "spectral_cliff": q_cliff, "energy_above": q_above, "band_delta_gated": q_bands, "spectral_features": q_features,
        "hf_envelope_corr": q_hf, "hf_modulation": q_modulation, "risk_regions": q_risk, "gain_curve": q_gain,
        "stereo_metrics": q_stereo, "mid_side_roundtrip": q_midside, "mono_downmix": q_mono, "peak_bars": q_bars,
        "loudness_gated": q_loudness, "loudness_range": q_range, "max_step": q_step, "loudest_window": q_loudest,
        "lag_correlation": q_lag, "sliding_correlation": q_sliding, "correlation_summary": q_summary, "fine_correlation": q_fine,
        "donor_match": q_donor, "event_splice_union": q_splice, "chroma_histogram": q_chroma, "decode_notes": q_decode,
        "chunk_spans": q_spans, "overlap_add": q_overlap, "crossfade_splice": q_crossfade, "peak_limiter": q_limit,
        "gain_staging": q_staging, "reference_rank": q_rank, "reference_fallback": q_fallback, "pair_names": q_pairs,
        "unpaired_names": q_unpaired, "transient_windows": q_transients, "quality_report": q_report, "verdict": q_verdict,
        "batch_verdict": q_batch, "offset_estimate": q_offset, "key_profile": q_key, "column_normalize": q_columns,
        "phase_accumulate": q_phase, "nearest_peak": q_peaks, "match_channels": q_match, "source_layout": q_delta,
        "stage_integrity": q_integrity, "stem_summary": q_stem_sum, "repair_rollback": q_rollback, "labels_and_rates": q_labels,
        "mid_side_retry": q_retry, "waveform_scaling": q_scaled, "settings_parse": q_settings,
        "local_offset_track": q_track, "dtw_distance": q_dtw, "coherence": q_coherence, "model_hook": partial(model, stand_in),
        "wav_roundtrip": q_wav, "chunked_model": q_chunks, "k_weight": q_k_weight, "k_weighted_loudness": q_k_loudness, "signal_description": q_describe,
        "resample": q_resample,
        "phase_warp": lambda spark, d: kernels.phase_warp(arrays(spark, d), [0.0, 30.0, 64.0], [0.0, 34.0, 66.0]),
        "pitch_shift": lambda spark, d: kernels.pitch_shift(arrays(spark, d), 3.0, 32, 8, 32),
        "onsets": lambda spark, d: kernels.onsets(arrays(spark, d), 4, 16),
    }


def oracle_sql():
    return dict(sql.QUERIES)
