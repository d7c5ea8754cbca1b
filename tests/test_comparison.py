"""Known damage in, known figures out: tracking, loudness, spectra, swings, seams, and the whole comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import compare, events, kernels, levels, report, spectral, tempo, timing


def test_a_drift_past_the_search_radius_is_followed(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    late = np.zeros(4000)
    for at in range(0, 4000, 100):  # five samples more every hundred: 200 in the end, four times the radius
        shift = at // 20
        part = x[at : at + 100][: max(0, 4000 - at - shift)]
        late[at + shift : at + shift + len(part)] = part
    ab = spark.createDataFrame([(1, i, float(x[i]), float(late[i])) for i in range(4000)], "sig long, i long, a double, b double")
    got = kernels.track_offsets(ab, 100, 100, 50).orderBy("w").collect()
    assert [r.lag for r in got] == [5 * w for w in range(len(got))] and len(got) >= 38
    s = timing.correlation_summary(spark.createDataFrame([(1, r.lag, r.score) for r in got], "pair long, start long, score double")).first()
    assert s.drift == got[-1].lag and s.max_offset == got[-1].lag


def test_a_bad_window_is_not_hidden(spark):
    w = [(1, 3, 0.9), (1, 4, 0.95), (1, -40, 0.2), (2, 7, 0.1)]
    got = {r.pair: r for r in timing.correlation_summary(spark.createDataFrame(w, "pair long, start long, score double")).collect()}
    assert got[1].corr_min == 0.2 and got[1].corr_median == 0.9 and got[1].drift == 1 and got[1].max_offset == 4 and got[1].confident == 2
    assert got[2].corr_min == 0.1 and got[2].max_offset == 7 and got[2].confident == 1


def test_ramps_run_from_nothing_to_all(spark):
    spans = spark.createDataFrame([(1, i) for i in range(20)], "sig long, i long")
    w = [r.w for r in spans.select(events.taper(F.col("i") + 10, F.lit(10), F.lit(30), F.lit(100), 6).alias("w")).collect()]
    want = np.sin(np.linspace(0, np.pi / 2, 6)) ** 2
    assert np.allclose(w[:6], want) and np.allclose(w[-6:], want[::-1]) and w[0] == 0 and w[6:14] == [1] * 8


def test_a_patch_past_the_end_is_cut_and_faded_there(spark):
    s = spark.createDataFrame([(1, i, 1.0) for i in range(30)], "sig long, i long, x double")
    patch = spark.createDataFrame([(1, j, 3.0) for j in range(50)], "sig long, j long, p double")
    y = [r.y for r in events.crossfade(s, patch, 20, 50, 4).orderBy("i").collect()]
    t = np.linspace(0, np.pi / 2, 4)
    assert y[:20] == [1.0] * 20 and np.allclose(y[20:24], np.cos(t) + 3 * np.sin(t)) and np.allclose(y[24:26], 3)
    assert np.allclose(y[26:], 3 * np.cos(t) + np.sin(t)) and y[-1] == pytest.approx(1.0)


def test_chroma_lasts_until_the_last_note_ends(spark):
    n = spark.createDataFrame([(1, 0.0, 1.0, 60), (1, 3.5, 3.0, 64)], "sig long, onset double, dur double, pitch int")
    assert sorted((r.pc, r.beat) for r in events.chroma(n, 1.0).collect()) == [(0, 0), (4, 3)]
    assert sorted(r.beat for r in events.chroma(n, 4.0).collect()) == [0, 0]


def test_a_slow_swing_is_found_between_bins(spark):
    rate, rows = 20.0, []
    for sig, (period, seconds) in enumerate(((9.0, 15.0), (5.0, 40.0), (1.0, 15.0), (9.0, 3.0))):
        rows += [(sig, k, 3 * float(np.sin(2 * np.pi * k / rate / period)) - 60) for k in range(int(seconds * rate))]
    got = {r.sig: r for r in spectral.modulation(spark.createDataFrame(rows, "sig long, k long, x double"), rate).collect()}
    assert got[0].period == pytest.approx(9, rel=0.1) and got[0].depth > 2 and got[1].period == pytest.approx(5, rel=0.02)
    assert got[2].depth < 0.5 and (got[3].period, got[3].depth) == (0.0, 0.0)


def test_spectrum_of_2048_samples(spark):
    x = np.sin(2 * np.pi * 1000 * np.arange(6000) / 48_000)
    sig = spark.createDataFrame([(1, x.tolist())], "sig long, x array<double>")
    spec = spectral.dft(spectral.stft(sig), 2048, 48_000, window=spectral.hann(2048)).toPandas()
    assert spec.frame.nunique() == 1 + 6000 // 512
    top = spec[spec.frame == 5].set_index("bin").mag
    want = np.abs(np.fft.rfft(np.pad(x, 1024)[5 * 512 : 5 * 512 + 2048] * spectral.hann(2048)))
    assert np.allclose(top.sort_index(), want, atol=1e-9) and abs(top.idxmax() * 48_000 / 2048 - 1000) < 24


def test_k_weighting_is_the_plain_recursion():
    x = np.random.default_rng(2).normal(size=1000)
    for b, a in kernels.k_weighting(48_000):
        y = np.zeros(1000)
        for i in range(1000):
            past = lambda v, k: v[i - k] if i >= k else 0.0  # noqa: B023, E731
            y[i] = b[0] * x[i] + b[1] * past(x, 1) + b[2] * past(x, 2) - a[0] * past(y, 1) - a[1] * past(y, 2)
        assert np.allclose(kernels.biquad(x, b, a), y)


def test_loudness_of_a_tone_and_of_two_channels(spark):
    tone = (0.1 * np.sin(2 * np.pi * 997 * np.arange(96_000) / 48_000)).tolist()
    ch = spark.createDataFrame([(1, 0, tone), (2, 0, tone), (2, 1, tone)], "sig long, ch long, x array<double>")
    got = {r.sig: r.lufs for r in levels.integrated_loudness(kernels.block_power(ch, 48_000, 19_200, 4_800)).collect()}
    z = np.exp(-2j * np.pi * 997 / 48_000 * np.arange(3))
    gain = np.prod([abs(np.dot(b, z) / np.dot((1, *a), z)) for b, a in kernels.k_weighting(48_000)])
    assert got[1] == pytest.approx(-0.691 + 20 * np.log10(0.1 * gain) - 3.0103, abs=0.01) and got[2] - got[1] == pytest.approx(3.01, abs=0.01)


def test_gain_curve_of_an_expander(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=60_000) * 10 ** (-np.linspace(0, 80, 60_000) / 20) * 0.1
    quiet = np.sqrt(np.convolve(a * a, np.ones(2048) / 2048, "same")) < 1e-3
    b = np.where(quiet, a * 10 ** (-9 / 20), a)
    ab = spark.createDataFrame([(1, i, float(u), float(v)) for i, (u, v) in enumerate(zip(a, b))], "sig long, i long, a double, b double")
    row = report.dynamics(ab, 1024, 256).first()
    assert row.spread == pytest.approx(9, abs=0.3) and row.quiet == pytest.approx(-9, abs=0.3) and row.loud == pytest.approx(0, abs=0.1)


SR = 4000
SMALL = compare.Sizes(200.0, 1.0, 0.02, 1.0, 0.5, 0.25, 0.05, 0.05, 256, 64, 512, 1000.0, 2000.0, 0.5)


def play(seconds=5):
    """Decaying notes with noise, as two unlike channels."""
    rng = np.random.default_rng(4)
    x = np.zeros(seconds * SR)
    for k, at in enumerate(range(SR // 4, len(x) - SR // 2, SR // 2)):
        n = np.arange(SR // 2)
        x[at : at + len(n)] += 0.3 * np.exp(-n / 500) * np.sin(2 * np.pi * (220 + 40 * (k % 5)) * n / SR)
    x += rng.normal(size=len(x)) * 0.004
    return np.stack([x, 0.6 * x + rng.normal(size=len(x)) * 0.004])


def table(spark, signals):
    return spark.createDataFrame([(s, c, row.tolist()) for s, y in signals.items() for c, row in enumerate(y)], "sig long, ch long, x array<double>")


def test_comparison_names_each_damage(spark):
    x = play()
    late = np.concatenate((np.zeros((2, 37)), x[:, :-37]), 1)
    fold = np.repeat(x.mean(0, keepdims=True), 2, 0)
    pairs = {1: x, 2: 0.5 * x, 3: late, 4: fold, 5: x[:1], 6: np.clip(1.0 * x / np.abs(x).max() * 1.5, -1, 1)}
    got = {r.sig: r for r in compare.compare(table(spark, {s: x for s in pairs}), table(spark, pairs), SR, SMALL).collect()}
    assert set(got) == set(pairs)
    same = got[1]
    assert same.offset_ms == 0 and same.corr_min == pytest.approx(1) and same.drift_ms == 0 and same.fine_min == pytest.approx(1) and abs(same.program_gain) < 1e-9
    assert same.slope_delta == pytest.approx(0) and same.decay_delta == pytest.approx(0) and same.onsets_a == same.onsets_b > 3 and same.hf_coherence == pytest.approx(1)
    assert same.channels_preserved and same.side_mid_delta == 0 and same.lr_a == same.lr_b and same.step_a == same.step_b and same.lufs_a == same.lufs_b
    assert got[2].program_gain == pytest.approx(-6.02, abs=0.01) and got[2].lufs_b - got[2].lufs_a == pytest.approx(-6.02, abs=0.01) and got[2].corr_min == pytest.approx(1)
    assert got[2].slope_delta == pytest.approx(0, abs=0.01) and max(map(abs, got[2].bands.values())) < 1e-6
    assert got[3].offset_ms == pytest.approx(1000 * 37 / SR) and got[3].drift_ms == 0 and got[3].corr_median > 0.99
    assert got[4].side_mid_delta < -30 and got[4].channels_preserved and got[4].lr_b == pytest.approx(1)
    assert not got[5].channels_preserved and got[5].side_mid_b == float("-inf")
    assert got[6].clipped_out > got[6].clipped_in == 0
    verdicts = {r.sig: r for r in report.verdict(spark.createDataFrame(list(got.values()), compare.compare(table(spark, {1: x}), table(spark, {1: x}), SR, SMALL).schema)).collect()}
    assert verdicts[1].passed and verdicts[2].passed and verdicts[3].passed and "channels" in verdicts[5].problems and "clipping" in verdicts[6].problems


def test_a_row_depends_on_no_other_row(spark):
    """A pair of three seconds, 37 samples late, gives the same beside one of twelve seconds."""
    short, long = play(3), play(12)
    late = lambda x: np.concatenate((np.zeros((2, 37)), x[:, :-37]), 1)
    alone = compare.compare(table(spark, {1: short}), table(spark, {1: late(short)}), SR, SMALL).first()
    both = {r.sig: r for r in compare.compare(table(spark, {1: short, 2: long}), table(spark, {1: late(short), 2: late(long)}), SR, SMALL).collect()}
    assert alone.offset_ms == both[1].offset_ms == both[2].offset_ms == pytest.approx(1000 * 37 / SR)
    assert alone.offset_score == pytest.approx(both[1].offset_score) and alone.offset_score > 0.99
    assert alone.bands == pytest.approx(both[1].bands) and alone.slope_b == pytest.approx(both[1].slope_b)


def test_one_grid_for_all_stems(spark):
    n = 6 * SR
    x = np.sin(2 * np.pi * 200 * np.arange(n) / SR)
    stems = [(1, "Bass", 0, 0, x.tolist()), (1, "Drums", 1, 0, x.tolist()), (1, "Drums", 1, 1, x.tolist()), (2, "Anything", 0, 0, x.tolist()), (3, "Voice", 0, 0, x.tolist()), (3, "Keys", 1, 0, x.tolist())]
    uneven = [0.5 + 0.5 * k + 0.03 * (k % 2) for k in range(11)]
    beats = [(1, "Drums", t) for t in uneven] + [(1, "Bass", 0.5)] + [(2, "Anything", 0.5 * k) for k in range(1, 11)] + [(3, "Voice", t) for t in uneven]
    s, b = spark.createDataFrame(stems, "song long, name string, pos int, ch int, x array<double>"), spark.createDataFrame(beats, "song long, name string, t double")
    got = {(r.song, r.name, r.ch): r for r in tempo.correct_tempo(s, b, SR, ("drums", "bass"), 256, 64).collect()}
    assert len(got) == 6 and {r.status for k, r in got.items() if k[0] == 1} == {"corrected"} and {r.reference for k, r in got.items() if k[0] == 1} == {"Drums"}
    assert got[1, "Bass", 0].y == got[1, "Drums", 0].y == got[1, "Drums", 1].y and got[1, "Bass", 0].y != x.tolist()
    assert got[2, "Anything", 0].status == "even" and got[2, "Anything", 0].y == x.tolist()
    assert got[3, "Keys", 0].status == "no reference" and got[3, "Keys", 0].y == x.tolist() and got[3, "Voice", 0].reference is None
    warped = np.array(got[1, "Bass", 0].y)[SR : 4 * SR]
    assert np.abs(warped).max() < 1.3 and np.sqrt(np.mean(warped**2)) == pytest.approx(np.sqrt(0.5), rel=0.1)


def test_chunks_through_a_model_that_returns_short(spark):
    x = np.random.default_rng(5).normal(size=230).tolist()
    s = spark.createDataFrame([(1, x), (2, x[:15])], "sig long, x array<double>")
    same = events.process_chunks(s, lambda: lambda v: v, 50, 12)
    assert np.allclose([r.y for r in same.where("sig = 1").orderBy("i").collect()], x) and same.where("sig = 2").count() == 15
    short = events.process_chunks(s, lambda: lambda v: v[:-7], 50, 12)
    assert np.allclose([r.y for r in short.where("sig = 1").orderBy("i").collect()], x)
    half = events.process_chunks(s, lambda: lambda v: np.concatenate((v, v)) * 0.5, 50, 12)
    assert np.allclose([r.y for r in half.where("sig = 1").orderBy("i").collect()], np.array(x) / 2)


def test_gain_staging_comes_back(spark):
    s = spark.createDataFrame([(1, i, 0.1 * i) for i in range(11)] + [(2, 0, 0.2)], "sig long, i long, x double")
    staged = events.stage_gain(s)
    assert staged.agg(F.max(F.abs("x"))).first()[0] == pytest.approx(0.5) and {round(r.gain, 9) for r in staged.collect()} == {0.5, 1.0}
    assert np.allclose([r.x for r in events.unstage_gain(staged).orderBy("sig", "i").collect()], [r.x for r in s.orderBy("sig", "i").collect()])


def test_mid_side_of_mono_fails(spark):
    with pytest.raises(Exception, match="two channels"):
        spectral.to_mid_side(spark.createDataFrame([(1, 0, 0.5, None)], "pair long, i long, l double, r double")).collect()


def test_files_in_and_out(spark, tmp_path):
    import json

    from sigloom.sources import audio

    x = np.stack([np.sin(np.arange(4000) * 0.05), np.cos(np.arange(4000) * 0.05)], 1).astype(np.float32) * 0.5
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.wav").write_bytes(audio.render_wav(x, 32_000))
    assert [tuple(r)[1:] for r in audio.probe(spark, f"{tmp_path}/in").collect()] == [(32_000, 2, 4000)]
    forced = audio.load_stems(spark, f"{tmp_path}/in", target_sr=16_000, channels=3)
    assert {(r.sr, r.channels, r.n) for r in forced.collect()} == {(16_000, 2, 2000)} and {r.ch for r in forced.collect()} == {0, 1, 2}
    written = audio.save_wavs(audio.load_stems(spark, f"{tmp_path}/in"), f"{tmp_path}/out").collect()
    rate, y = audio.parse_wav((tmp_path / "out/one.wav").read_bytes())
    assert len(written) == 1 and rate == 32_000 and np.abs(x - y).max() < 1e-6
    audio.write_report(spark.createDataFrame([("one", 1.5, "drift,clipping"), ("two", 2.5, "")], "sig string, corr double, problems string"), f"{tmp_path}/json")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert {k: v for line in lines for k, v in line.items()} == {"one": {"report": {"corr": 1.5}, "problems": ["drift", "clipping"]}, "two": {"report": {"corr": 2.5}, "problems": []}}


def test_frames_of_any_window_and_hop(spark):
    x = np.random.default_rng(6).normal(size=200)
    s = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "sig long, i long, x double")
    for window, hop in ((48, 18), (50, 7), (10, 25), (40, 10)):
        for last in (True, False):
            got = {r.frame: r.power for r in levels.frame_power(s, window, hop, last).collect()}
            want = {k: np.mean(x[at : at + window] ** 2) for k, at in enumerate(range(0, 200 - window + last, hop))}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want), (window, hop, last)
