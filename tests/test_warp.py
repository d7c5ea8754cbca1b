"""The warp keeps the stereo image, its length and its beats, and doesn't depend on the blocks it is cut into."""

import numpy as np
import pytest

from sigloom.operators import tempo, timing, warp

SR = 16_000


def stereo(seconds=4):
    """Unlike channels: shared notes, each with notes of its own, and different phases."""
    n, t = SR * seconds, np.arange(SR * seconds) / SR
    notes = lambda hz, seed: sum(np.sin(2 * np.pi * f * t + seed * k) / (k + 1) for k, f in enumerate(hz)) * (0.6 + 0.4 * np.sin(2 * np.pi * (1 + seed) * t))
    shared = notes((220, 440, 661, 1320), 0.3)
    left, right = shared + 0.4 * notes((311, 933), 0.7), 0.8 * np.roll(shared, 3) + 0.4 * notes((523, 1569), 1.1)
    return 0.2 * np.stack([left, right])[:, :n]


def image(x):
    mid, side = x.mean(0), (x[0] - x[1]) / 2
    return np.corrcoef(x)[0, 1], 10 * np.log10((side**2).mean() / (mid**2).mean())


def tables(spark, signals, maps):
    stems = spark.createDataFrame([(s, c, row.tolist()) for s, x in signals.items() for c, row in enumerate(x)], "sig long, ch long, x array<double>")
    return stems, spark.createDataFrame([(s, a, b) for s, m in maps.items() for a, b in m], "sig long, src long, dst long")


def read(df):
    out = {}
    for r in df.orderBy("sig", "ch").collect():
        out.setdefault(r.sig, []).append(r.y)
    return {k: np.array(v) for k, v in out.items()}


def five_percent(n):
    return [(0, 0), (n // 3, int(n // 3 * 1.05)), (2 * n // 3, int(2 * n // 3 * 1.05)), (n, int(n * 1.05))]


def test_the_stereo_image_stays(spark):
    x = stereo()
    n = x.shape[1]
    y = read(warp.warp_arrays(*tables(spark, {1: x}, {1: five_percent(n)})))[1]
    assert y.shape == (2, int(n * 1.05))
    (corr, depth), (corr2, depth2) = image(x), image(y)
    assert abs(corr - corr2) < 0.02 and abs(depth - depth2) < 0.5
    assert np.sqrt((y**2).mean()) == pytest.approx(np.sqrt((x**2).mean()), rel=0.05)


def test_blocks_make_no_difference(spark):
    x = stereo(2)
    n = x.shape[1]
    still = [(0, 0), (n, n)]
    signals = {1: x, 2: x[:1, : n // 2], 3: x, 4: x[:, :100]}
    stems, anchors = tables(spark, signals, {1: five_percent(n), 2: [(0, 0), (4000, 3700), (n // 2, n // 2 - 300)], 3: still, 4: [(0, 0), (100, 105)]})
    one, many = read(warp.warp_arrays(stems, anchors, 512, 128, 1 << 30, 1 << 20)), read(warp.warp_arrays(stems, anchors, 512, 128, 1777, 9))
    assert one.keys() == many.keys() == {1, 2}
    for k in one:
        assert one[k].shape == many[k].shape and np.abs(one[k] - many[k]).max() < 1e-9


def test_a_click_lands_where_the_map_says(spark):
    x = np.zeros((1, SR))
    x[0, 8000] = 1.0
    maps = [(0, 0), (4000, 4200), (12_000, 12_900), (SR, SR + 900)]
    y = read(warp.warp_arrays(*tables(spark, {1: x}, {1: maps}), 512, 64))[1][0]
    at = spark.createDataFrame([(1, int(k)) for k in range(0, SR + 900, 50)], "sig long, dst long")
    positions = {r.dst: r.src for r in timing.read_warp(spark.createDataFrame([(1, a, b) for a, b in maps], "sig long, src long, dst long"), at).collect()}
    expected = min(positions, key=lambda d: abs(positions[d] - 8000))
    assert abs(int(np.argmax(np.abs(y))) - expected) < 300


def test_positions_are_those_of_the_table_operator(spark):
    maps = [(0, 0), (4000, 4200), (9000, 8800), (12_000, 12_900), (SR, SR + 900)]
    anchors = spark.createDataFrame([(1, a, b) for a, b in maps], "sig long, src long, dst long")
    at = list(range(0, SR + 900, 333))
    want = {r.dst: r.src for r in timing.read_warp(anchors, spark.createDataFrame([(1, k) for k in at], "sig long, dst long")).collect()}
    rows = timing.with_slopes(anchors).orderBy("dst").collect()
    got = warp.cubic(tuple(np.array([r[c] for r in rows], float) for c in ("dst", "src", "slope")), np.array(at, float))
    assert np.allclose(got, [want[k] for k in at])


def test_owner_is_the_nearest_peak():
    rng = np.random.default_rng(2)
    m = rng.random((20, 40))
    got = warp.owners(m)
    for row, found in zip(m, got, strict=True):
        wide = np.concatenate(([-1], row, [-1]))
        peaks = [k for k in range(40) if wide[k + 1] >= wide[k] and wide[k + 1] >= wide[k + 2]]
        assert found.tolist() == [min(peaks, key=lambda p: (abs(p - k), p)) for k in range(40)]
    assert warp.owners(np.zeros((1, 5))).tolist() == [[0, 1, 2, 3, 4]]


def test_stems_of_unequal_length_share_the_grid(spark):
    """The corrected stereo stem keeps its image; a shorter stem ends by its own length."""
    x = stereo()
    n = x.shape[1]
    stems = [(1, "Drums", 0, c, x[c].tolist()) for c in (0, 1)] + [(1, "Bass", 1, 0, x[0, : n // 2].tolist())]
    beats = [(1, "Drums", 0.3 + 0.3 * k + 0.02 * (k % 2)) for k in range(12)]
    s, b = spark.createDataFrame(stems, "song long, name string, pos int, ch int, x array<double>"), spark.createDataFrame(beats, "song long, name string, t double")
    got = {(r.name, r.ch): r for r in tempo.correct_tempo(s, b, SR, ("drums",)).collect()}
    y = np.stack([got["Drums", 0].y, got["Drums", 1].y])
    assert {r.status for r in got.values()} == {"corrected"} and abs(len(got["Bass", 0].y) - n // 2) < 2000
    (corr, depth), (corr2, depth2) = image(x), image(y)
    assert abs(corr - corr2) < 0.02 and abs(depth - depth2) < 0.5
