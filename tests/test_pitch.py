"""Planted clicks, scales and alignments."""

import numpy as np
import pytest

from sigloom.operators import pitch

SR = 22_050


def test_planted_clicks_are_found_within_ten_milliseconds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=SR * 20) * 1e-3
    at = np.sort(rng.choice(np.arange(1, 78), 60, replace=False)) * (SR // 4) + rng.integers(0, 2000, 60)
    for p in at:
        n = np.arange(3000)
        x[p : p + 3000] += 0.5 * np.exp(-n / 400) * np.sin(2 * np.pi * rng.integers(200, 3000) * n / SR)
    df = spark.createDataFrame([(1, x.tolist()), (2, [0.0] * 5000), (3, [0.1] * 100)], "sig long, x array<double>")
    got = {r.sig: np.array(r.y) for r in pitch.onsets(df, SR, 1024, 128).collect()}
    near = lambda p, y: np.abs(y - p).min() <= SR // 100
    assert np.mean([near(p, got[1]) for p in at]) >= 0.95 and np.mean([near(p, at) for p in got[1]]) >= 0.95
    assert len(got[2]) == len(got[3]) == 0


def scale(first, octave=4):
    steps = (0, 2, 4, 5, 7, 9, 11, 12)
    t = np.arange(SR // 2) / SR
    hz = [440 * 2 ** ((first + s - 9) / 12 + octave - 4) for s in steps]
    return np.concatenate([sum(np.sin(2 * np.pi * f * h * t) / h for h in (1, 2, 3)) * np.minimum(1, 30 * np.minimum(t, 0.5 - t)) for f in hz])


def test_chroma_names_the_notes():
    v = pitch.chroma_array(scale(0), SR)
    names = v.argmax(1)
    middle = [names[int((k + 0.5) * SR / 2 / 512)] for k in range(8)]
    assert middle == [0, 2, 4, 5, 7, 9, 11, 0] and v.max() == 1 and pitch.chroma_array(np.zeros(9000), SR).max() == 0


def test_a_transposed_scale_is_further_away(spark):
    rows = [(1, scale(0), scale(0)), (2, scale(0), scale(0, 5)), (3, scale(0), scale(6))]
    pairs = spark.createDataFrame([(s, pitch.chroma_array(a, SR, 2048).ravel().tolist(), pitch.chroma_array(b, SR, 2048).ravel().tolist()) for s, a, b in rows], "sig long, x array<double>, y array<double>")
    got = {r.sig: r.distance for r in pitch.chroma_distance(pairs).collect()}
    assert got[1] == pytest.approx(0) and got[1] < got[2] < 0.7 * got[3]


def brute(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            c = np.linalg.norm(a[i] - b[j])
            d[i + 1, j + 1] = c if i == j == 0 else min(d[i, j + 1] + c, d[i + 1, j] + c, d[i, j] + 2 * c)
    return d[-1, -1] / (len(a) + len(b))


def test_alignment_by_anti_diagonals_is_that_by_cells():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 7), (9, 1), (12, 17), (30, 11)):
        a, b = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
        assert pitch.align_cost(a, b) == pytest.approx(brute(a, b))
        assert pitch.align_cost(a, b, 100) == pytest.approx(brute(a, b))
        assert pitch.align_cost(a, b, 3) >= brute(a, b) - 1e-12
    assert np.isnan(pitch.align_cost(np.zeros((0, 3)), b))


def test_mel_bands_cover_the_spectrum():
    bank = pitch.mel_bank(SR, 2048, 40)
    assert bank.shape == (1025, 40) and (bank >= 0).all() and (bank.sum(0) > 0).all()
    top = bank.argmax(0) * SR / 2048
    assert (np.diff(top) > 0).all() and top[-1] > 9000
