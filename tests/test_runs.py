"""Whole runs over WAV files: outputs in their own layout, failing stems beside the others, reruns that go on where a run ended."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import runs
from sigloom.sources import audio

SR = 16_000


def tone(hz, seconds=2, level=0.3):
    return level * np.sin(2 * np.pi * hz * np.arange(int(SR * seconds)) / SR)


@pytest.fixture
def folder(tmp_path):
    signals = {"Drums": np.stack([tone(300), tone(1100)], 1), "Bass": tone(110)[:, None], "Silent": np.zeros((SR, 2))}
    (tmp_path / "in").mkdir()
    for name, x in signals.items():
        (tmp_path / f"in/{name}.wav").write_bytes(audio.render_wav(x, SR))
    (tmp_path / "in/broken.wav").write_bytes(b"RIFF nothing")
    return tmp_path, signals


def softer():
    return lambda x: 0.9 * x


def picky():
    def model(x):
        if len(x) == 1:
            raise ArithmeticError("no mono")
        return x[:, :-5]

    return model


def folding():
    return lambda x: x.mean(0, keepdims=True)


def test_stems_come_out_and_failures_are_listed(spark, folder):
    path, signals = folder
    beats = spark.createDataFrame([("Drums", 0.2 + 0.25 * k + 0.015 * (k % 2)) for k in range(7)], "name string, t double")
    report, run = runs.restore(spark, f"{path}/in", f"{path}/out", f"{path}/work", beats, ("drum",), softer, picky, 512, 128, (1024, 256), 4000.0)
    rows = {r.name: r for r in report.collect()}
    assert set(rows) == {"Drums", "Silent"} and sorted(os.listdir(path / "out")) == ["Drums_restored.wav", "Silent_restored.wav"]
    r = rows["Drums"]
    assert (r.channels_in, r.channels_out, r.tempo, r.strategy) == (2, 2, "corrected", "joint") and r.residual == pytest.approx(-20, abs=0.1) and r.sr == SR
    assert rows["Silent"].strategy == "skipped"
    rate, x = audio.parse_wav((path / "out/Drums_restored.wav").read_bytes())
    assert rate == SR and x.shape == (r.n_out, 2) and np.sqrt((x**2).mean()) == pytest.approx(0.9 * 0.3 / np.sqrt(2), rel=0.1)
    failed = {(f.stage, f.key): (f.kind, f.message) for f in run.failures().collect()}
    assert failed["bandwidth", "Bass"] == ("ArithmeticError", "no mono") and failed["loaded", "broken"][0] in ("ValueError", "error") and len(failed) == 2
    lines = [x.line for x in run.summary().collect()]
    assert len(lines) == len(run.manifests) and any("1 failed" in line for line in lines)


def test_a_changed_channel_count_is_a_failure(spark, folder):
    path, _ = folder
    report, run = runs.restore(spark, f"{path}/in", f"{path}/out", f"{path}/work", extender=folding, frames=(1024, 256))
    assert {r.name for r in report.collect()} == {"Bass", "Silent"}
    assert {(f.stage, f.key, f.kind) for f in run.failures().where("stage = 'checked'").collect()} == {("checked", "Drums", "IntegrityError")}


def test_a_run_goes_on_after_its_last_whole_stage(spark, tmp_path):
    made = []

    def stage(run, name, settings="", fail=False):
        def make():
            made.append(name)
            rows = spark.range(5).withColumn("name", F.concat(F.lit(name), "id"))
            return rows.withColumn("id", F.when(F.col("id") == 4, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id"))) if fail else rows

        return run.stage(name, make, settings)

    first = runs.Run(spark, str(tmp_path))
    stage(first, "a")
    stage(first, "b")
    with pytest.raises(Exception, match="killed"):
        stage(first, "c", fail=True)
    again = runs.Run(spark, str(tmp_path))
    for name in "abc":
        assert stage(again, name).count() == 5
    assert made == ["a", "b", "c", "c"] and again.skipped == ["a", "b"]
    third = runs.Run(spark, str(tmp_path))
    stage(third, "a")
    stage(third, "b", settings="other")  # other settings: this stage and those after it are made again
    stage(third, "c")
    assert made[4:] == ["b", "c"] and third.skipped == ["a"]
    folder = third.manifests[-1]["path"]
    part = next(f for f in os.listdir(folder) if f.startswith("part-"))
    os.remove(f"{folder}/{part}")
    fourth = runs.Run(spark, str(tmp_path))
    for name, settings in (("a", ""), ("b", "other"), ("c", "")):
        assert stage(fourth, name, settings).count() == 5
    assert made[6:] == ["c"] and fourth.skipped == ["a", "b"]


def test_both_versions_are_kept(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.concatenate([tone(262 * 2 ** ((k % 3) / 12), 0.5) * np.minimum(1, np.arange(SR // 2)[::-1] / 800) for k in range(12)])
    x += rng.normal(size=len(x)) * 1e-5
    x[int(2.5 * SR) : int(4.0 * SR)] = rng.normal(size=int(1.5 * SR)) * 0.1
    (tmp_path / "in").mkdir()
    (tmp_path / "in/song.wav").write_bytes(audio.render_wav(np.stack([x, 0.5 * x], 1), SR))
    notes = spark.createDataFrame([(k, k / 2, 0.5, 60 + k % 3) for k in range(12)], "k long, onset double, dur double, pitch long")
    report, _ = runs.restore_from_stem(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/work", notes, notes, SR, frames=(1024, 256))
    row = report.first()
    assert row.repair == "repaired" and row.risk_after < row.risk_before and row.channels_in == row.channels_out == 2
    assert os.listdir(tmp_path / "out/v2") == ["song_v2.wav"] and os.listdir(tmp_path / "out/v3") == ["song_restored.wav"]
    two, three = (audio.parse_wav((tmp_path / f"out/{n}").read_bytes())[1] for n in ("v2/song_v2.wav", "v3/song_restored.wav"))
    assert two.shape == three.shape == (len(x), 2) and np.abs(two - three).max() < 1e-5 and np.abs(two[:, 0] - x).max() > 0.05
    (tmp_path / "in/other.wav").write_bytes(audio.render_wav(x, SR))
    with pytest.raises(ValueError, match="more than one"):
        runs.restore_from_stem(spark, f"{tmp_path}/in", f"{tmp_path}/out2", f"{tmp_path}/work2", notes, notes, SR)
