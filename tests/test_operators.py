import numpy as np
import pytest

from sigloom.operators import events, kernels, levels, report, spectral, timing
from sigloom.sources import audio


def signal(spark, x, sig=1):
    return spark.createDataFrame([(sig, i, float(v)) for i, v in enumerate(x)], "sig long, i long, x double")


def test_identity_changes_nothing(spark):
    x = np.random.default_rng(0).normal(0, 0.1, 400)
    ab = signal(spark, x).selectExpr("sig", "i as k", "cast(i as double) as t", "x as a", "x as b")
    row = report.quality_report(ab).first()
    assert row.residual == float("-inf") and abs(row.program_gain) < 1e-9 and row.spread < 1e-9
    assert report.verdict(report.quality_report(ab)).first().passed


def test_gain_is_only_gain(spark):
    x = np.random.default_rng(0).normal(0, 0.1, 400)
    ab = signal(spark, x).selectExpr("sig", "i as k", "cast(i as double) as t", "x as a", "x * 0.5 as b")
    row = report.quality_report(ab).first()
    assert row.program_gain == pytest.approx(-6.0206, abs=1e-3) and row.spread < 1e-6 and row.corr == pytest.approx(1.0)


def test_loudness_follows_gain(spark):
    x = np.random.default_rng(1).normal(0, 0.1, 4000)
    a, b = (levels.frame_power(signal(spark, x * g), 400, 100) for g in (1.0, 0.5))
    la, lb = levels.integrated_loudness(a).first().lufs, levels.integrated_loudness(b).first().lufs
    assert lb - la == pytest.approx(-6.02, abs=0.1)
    assert levels.loudness_range(a).first().lra == pytest.approx(levels.loudness_range(b).first().lra, abs=1e-6)


def test_silent_signal_is_minus_infinity(spark):
    f = levels.frame_power(signal(spark, np.zeros(1000)), 400, 100)
    assert levels.integrated_loudness(f).first().lufs == float("-inf")


def test_frame_count_with_and_without_the_last(spark):
    s = signal(spark, np.ones(1000))
    assert levels.frame_power(s, 400, 100, last=True).count() == 7
    assert levels.frame_power(s, 400, 100, last=False).count() == 6


def test_lag_sign_is_positive_when_late(spark):
    x = np.random.default_rng(2).normal(size=200)
    rows = [(1, i, float(x[i]), float(x[i - 3]) if i >= 3 else 0.0) for i in range(200)]
    lr = spark.createDataFrame(rows, "pair long, i long, l double, r double")
    assert timing.best_lag(lr, 8).first().lag == 3


def test_overlap_add_of_identity_returns_the_input(spark):
    x = np.random.default_rng(3).normal(size=100)
    s = signal(spark, x)
    n = spark.createDataFrame([(1, 100)], "sig long, n long")
    y = events.overlap_add(s, events.chunk_spans(n, 20, 6), 6, lambda v: v).orderBy("i").toPandas().y
    assert np.allclose(y, x)


def test_even_beats_need_no_warp(spark):
    b = spark.createDataFrame([(1, 0.5 * i) for i in range(20)], "sig long, t double")
    a = timing.warp_anchors(b, 100, spark.createDataFrame([(1, 1000)], "sig long, n long"))
    assert a.where("src <> dst").count() == 0 and timing.describe_warp(a).first().corrected == 0


def test_few_beats(spark):
    b = spark.createDataFrame([(1, 0.5), (1, 1.0)], "sig long, t double")
    row = timing.tempo_stability(b).first()
    assert row.n_beats == 2 and row.bpm_median is None


def test_region_merges_and_pads(spark):
    x = [0.1] * 40
    for i in (10, 11, 13, 30):
        x[i] = 0.9
    s = signal(spark, x).withColumnRenamed("i", "k")
    row = timing.risk_region(s, 0.5).first()
    assert row.start == pytest.approx(5.0 - 0.25) and row.end == pytest.approx(6.5 + 0.25)


def test_stereo_collapse(spark):
    x = np.random.default_rng(4).normal(size=64)
    lr = spark.createDataFrame([(1, i, float(v), float(v)) for i, v in enumerate(x)], "pair long, i long, l double, r double")
    row = spectral.stereo_metrics(lr).first()
    assert row.side_mid_db == float("-inf") and row.corr == pytest.approx(1.0)


def test_partial_triplet_is_dropped(spark):
    e = spark.createDataFrame([(1, [100, 10050, 11060, 200]), (2, [])], "sig long, events array<long>")
    rows = events.decode_notes(e).collect()
    assert [(r.onset, r.dur, r.pitch, r.instrument) for r in rows] == [(1.0, 0.5, 60, 0)]


def test_wav_round_trip(spark, tmp_path):
    x = np.random.default_rng(5).uniform(-0.9, 0.9, (1000, 2)).astype(np.float32)
    for bits in (16, 24, 32):
        rate, y = audio.parse_wav(audio.render_wav(x, 32_000, bits))
        assert rate == 32_000 and np.abs(x - y).max() < 2.0 ** (2 - min(bits, 24))
    (tmp_path / "b.WAV").write_bytes(audio.render_wav(x, 32_000))
    (tmp_path / "a.txt").write_text("no")
    assert [r.name for r in audio.discover_stems(spark, str(tmp_path)).collect()] == ["b"]
    blocks = audio.load_stems(spark, str(tmp_path))
    assert blocks.select("sr", "channels", "n").distinct().collect() == [(32_000, 2, 1000)]
    assert audio.samples(blocks).count() == 2000
    assert audio.parse_wav(bytes(audio.wav_bytes(blocks).first().content))[1].shape == (1000, 2)


def test_kernels():
    x = np.sin(np.arange(400) * 0.2)
    assert kernels.resample_array(x, 48, 48) is x
    assert len(kernels.resample_array(x, 48, 24)) == 200
    assert np.abs(kernels.resample_array(kernels.resample_array(x, 24, 48), 48, 24)[40:-40] - x[40:-40]).max() < 0.01
    assert kernels.phase_warp_array(x, np.array([0.0, 400.0]), np.array([0.0, 400.0])) is x
    assert len(kernels.phase_warp_array(x, np.array([0.0, 400.0]), np.array([0.0, 440.0]))) == 440
    for b, a in kernels.k_weighting(48_000):
        assert sum(b) / (1 + sum(a)) == pytest.approx(1 if sum(b) > 0.01 else 0, abs=1e-9)  # the shelf leaves low, the high-pass high frequencies
    (b, a), (d, c) = kernels.k_weighting(48_000)
    assert 20 * np.log10((b[0] - b[1] + b[2]) / (1 - a[0] + a[1])) == pytest.approx(4, abs=1e-3) and (d[0] - d[1] + d[2]) / (1 - c[0] + c[1]) == pytest.approx(1)


def test_stream_matches_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from sigloom.streaming import live

    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(str(src))
    q = live.hopping_levels(live.event_stream(spark, str(src), 10)).writeStream.outputMode("complete").format("memory").queryName("levels").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = spark.read.parquet(str(src)).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "2 hours", "1 hour"), "user_id").count()
    assert spark.table("levels").count() == batch.count()


def test_loud_sessions_merge_and_close(spark, tmp_path):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from sigloom.streaming import live

    start = datetime(2024, 1, 1)
    minutes = [(1, 0, 9.0), (1, 30, 8.0), (1, 50, 1.0), (1, 80, 7.0), (1, 200, 9.0), (2, 10, 2.0), (1, 100_000, 9.0)]
    rows = [(k, start + timedelta(minutes=m), u, "x", v, "{}") for k, (u, m, v) in enumerate(minutes)]
    frame = spark.createDataFrame(rows, live.SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    src = str(tmp_path / "in")
    frame.coalesce(1).write.parquet(src)
    q = live.loud_sessions(live.event_stream(spark, src), 5.0).writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.user_id, r.n, round(r["mean"], 6)) for r in spark.table("sessions").collect())
    assert got == [(1, 1, 9.0), (1, 3, 8.0)]  # the last session is still open
