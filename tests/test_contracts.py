"""Known answers of the verdict, warp map, offset, harmony, layout and MIDI operators."""

import pytest

from sigloom.operators import harmony, layout, report, timing
from sigloom.sources import midi


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def pair(spark, gain=1.0):
    x = [(1, k, k * 0.01, ((k * 37) % 101) / 150) for k in range(64)]
    return spark.createDataFrame([(s, k, t, a, a * gain) for s, k, t, a in x], "sig long, k long, t double, a double, b double")


def test_gain_alone_is_no_problem(spark):
    got = report.verdict(report.quality_report(pair(spark, 0.7))).first()
    assert got.passed and got.problems == ""


def test_each_rule_reports_its_problem(spark):
    ok = (1, 1, 0.0, 0.0, 1.0, {"500_1k": 0.0}, 0.0, 0.0, 0, 0)
    changed = {
        "channels": {1: 2}, "duration": {2: -5.1}, "drift": {3: 5.1}, "corr_min": {4: 0.89}, "band 10k_16k": {5: {"10k_16k": -1.6}},
        "attack slope": {6: -0.51}, "spread": {7: 6.1}, "clipping": {9: 1}, "": {5: {"20_100": 9.0, "16k_24k": 9.0}, 6: 3.0},
    }
    data = [(i, *(new.get(k, v) for k, v in enumerate(ok))) for i, new in enumerate(changed.values())]
    ddl = "sig long, channels_a int, channels_b int, duration_delta_ms double, drift_ms double, corr_min double, bands map<string,double>, slope_delta double, spread double, clipped_in long, clipped_out long"
    found = report.verdict(spark.createDataFrame(data, ddl))
    assert [r.problems for r in found.orderBy("sig").collect()] == list(changed)
    assert report.batch_verdict(found).first().asDict() == {"n": 9, "failed": 8, "passed": False}
    assert report.batch_verdict(found.limit(0)).first().passed


def warp(spark, anchors, at):
    a = spark.createDataFrame([(1, *x) for x in anchors], "sig long, src long, dst long")
    p = spark.createDataFrame([(1, x) for x in at], "sig long, dst long")
    return [r.src for r in timing.read_warp(a, p).orderBy("dst").collect()]


def test_warp_reads_a_monotone_cubic(spark):
    assert warp(spark, [(0, 0), (10, 20)], [5]) == [2.5]  # two anchors: the line
    got = warp(spark, [(0, 0), (100, 100), (210, 200), (300, 300)], range(0, 301, 10))
    assert got[0] == 0 and got[10] == 100 and got[20] == 210 and got[30] == 300
    assert all(a < b for a, b in zip(got, got[1:]))
    # Slopes 0.95, 2 / (1 / 1 + 1 / 1.1) at the first two anchors, by the rule; halfway they bend the line by h (d0 - d1) / 8.
    assert got[5] == pytest.approx(50 + 100 * (0.95 - 2 / (1 + 1 / 1.1)) / 8)


def test_a_delay_is_found_in_two_steps(spark):
    x = [((k * 7919) % 1009) / 1009 * (1 + (k // 50) % 7) / 7 for k in range(3000)]
    a = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "sig long, i long, x double")
    got = timing.estimate_offset(a, a.selectExpr("sig", "i + 63 AS i", "x"), 50, 10, 60, 8).first()
    assert got.offset == 63 and got.score == pytest.approx(1, abs=0.1)


def test_key_of_scales(spark):
    scale = lambda sig, root, steps: [(sig, float(2 if i == 0 else 1), root + s) for i, s in enumerate(steps)]
    n = scale(1, 60, (0, 2, 4, 5, 7, 9, 11)) + scale(2, 69, (0, 2, 3, 5, 7, 8, 10)) + [(3, 1.0, p) for p in range(12)]
    got = harmony.key_of(spark.createDataFrame(n, "sig long, dur double, pitch int"))
    assert {r.sig: r.key for r in got.collect()} == {1: "C major", 2: "A minor"}


def test_peaks_take_the_lower_of_two_as_near(spark):
    s = spark.createDataFrame([(0, 0, b, m) for b, m in enumerate((5.0, 1.0, 0.5, 1.0, 4.0))], "stem int, frame int, bin int, mag double")
    assert [r.peak for r in harmony.nearest_peak(s).orderBy("bin").collect()] == [0, 0, 0, 4, 4]


def test_channels_match_and_deltas_reach_all(spark):
    s = spark.createDataFrame([(1, 0, 0, 0.2), (1, 1, 0, 0.4)], "sig long, ch long, i long, x double")
    assert rows(layout.match_channels(s, 2)) == rows(s)
    assert [round(r.x, 9) for r in layout.match_channels(s, 3).collect()] == [0.3] * 3
    d = spark.createDataFrame([(1, 0, 0.7), (1, 9, 1.0)], "sig long, i long, d double")
    assert [round(x[3], 9) for x in rows(layout.apply_delta(s, d))] == [0.9, 1.0]


def test_stages_keep_stems_and_channels(spark):
    a = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "sig long, channels long")
    b = spark.createDataFrame([(1, 2), (2, 1), (4, 1)], "sig long, channels long")
    assert rows(layout.check_stage(a, b)) == [(2, "channels"), (3, "lost"), (4, "new")]
    assert rows(layout.require_stage(a, a)) == rows(a)
    with pytest.raises(Exception, match="channel count changed: 2"):
        layout.require_stage(a, b.where("sig < 3")).collect()


def test_a_repair_is_undone_unless_the_risk_fell(spark):
    b = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None)], "sig long, mean double")
    a = spark.createDataFrame([(1, 0.4), (2, 0.5)], "sig long, mean double")
    assert [r.kept for r in layout.keep_if_better(b, a).orderBy("sig").collect()] == [True, False, False]


def test_labels(spark):
    import math

    df = spark.createDataFrame([(None, 0.0), (0, 0.5), (16000, 2.0)], "hz int, iv double")
    got = df.select(layout.hz_label(df.hz).alias("h"), layout.target_bpm(df.iv).alias("b")).collect()
    assert [r.h for r in got] == ["none", "none", "16000Hz"] and math.isnan(got[0].b) and [r.b for r in got[1:]] == [120.0, 30.0]


def test_percent_labels(spark):
    df = spark.createDataFrame([(None,), (0.0,), (12.346,)], "v double")
    assert [r[0] for r in df.select(layout.percent_label(df.v)).collect()] == ["\u2014", "0.00%", "12.35%"]


def test_midi_round_trip(spark, tmp_path):
    want = [(0.0, 0.5, 60, 90, 0, 5), (0.25, 0.5, 64, 80, 0, 5), (0.5, 0.25, 60, 70, 0, 5), (1.0, 0.125, 36, 100, 9, 128)]
    assert midi.parse_midi(midi.render_midi(want)) == want
    (tmp_path / "a.mid").write_bytes(midi.render_midi(want))
    (tmp_path / "b.MIDI").write_bytes(midi.render_midi([]))
    (tmp_path / "c.txt").write_bytes(b"no")
    notes = midi.load_notes(spark, str(tmp_path))
    assert [tuple(r)[2:] for r in notes.orderBy("k").collect()] == want
    image = midi.midi_bytes(notes).first()
    assert image.name == "a" and bytes(image.content) == midi.render_midi(want)


def test_midi_running_status_and_tempo():
    # Two notes under one status byte, the second tempo twice as fast; a start of velocity 0 is a release.
    track = bytes([0, 0xFF, 0x51, 3]) + (1_000_000).to_bytes(3, "big") + bytes([0, 0x90, 60, 64, 96, 60, 0, 0, 0xFF, 0x51, 3]) + (500_000).to_bytes(3, "big") + bytes([0, 0x90, 62, 64, 96, 62, 0, 0, 0xFF, 0x2F, 0])
    data = b"MThd" + (6).to_bytes(4, "big") + bytes([0, 0, 0, 1, 0, 96]) + b"MTrk" + len(track).to_bytes(4, "big") + track
    assert midi.parse_midi(data) == [(0.0, 1.0, 60, 64, 0, 0), (1.0, 0.5, 62, 64, 0, 0)]
    with pytest.raises(ValueError):
        midi.parse_midi(b"RIFF")
