"""Signals in blocks give what one pass over the whole signal gives, wherever the blocks end."""

import numpy as np
import pytest

from sigloom.operators import blocks, kernels, levels

R = np.random.default_rng(11)


def channels(spark, signals):
    return spark.createDataFrame([(s, c, x.tolist()) for s, rows in signals.items() for c, x in enumerate(rows)], "sig long, ch long, x array<double>")


@pytest.fixture(scope="module")
def long(spark):
    signals = {1: R.normal(size=(2, 5000)), 2: R.normal(size=(1, 300)), 3: np.zeros((1, 700)), 4: R.normal(size=(1, 1))}
    return signals, channels(spark, signals).cache()


@pytest.mark.parametrize("size", [128, 333, 100_000])
def test_blocks_come_back_and_filter_as_one(spark, long, size):
    signals, df = long
    parts = blocks.to_blocks(df, size)
    back = {(r.sig, r.ch): r.x for r in blocks.from_blocks(parts).collect()}
    assert all(np.array_equal(back[s, c], x) for s, rows in signals.items() for c, x in enumerate(rows))
    got = {(r.sig, r.ch): np.array(r.x) for r in blocks.from_blocks(blocks.k_weighted(parts, 48_000)).collect()}
    for s, rows in signals.items():
        for c, x in enumerate(rows):
            want = x
            for b, a in kernels.k_weighting(48_000):
                want = kernels.biquad(want, b, a)
            assert np.abs(got[s, c] - want).max() < 1e-9


@pytest.mark.parametrize("size", [200, 1000])
def test_power_of_frames_without_shuffling_samples(spark, long, size):
    _, df = long
    want = {(r.sig, r.frame): r.power for r in kernels.block_power(df, 48_000, 400, 100).collect()}
    got = {(r.sig, r.frame): r.power for r in blocks.k_weighted_power(blocks.to_blocks(df, size), 48_000, size, 400, 100).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    plan = blocks.k_weighted_power(blocks.to_blocks(df, size), 48_000, size, 400, 100)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and not any("x#" in line for line in exchanged)


def test_ten_minutes_spread_over_tasks(spark):
    """A signal of ten minutes at 8 kHz, made block by block, is filtered as in one pass."""
    n, size = 8000 * 600, 1 << 16
    tone = lambda at: np.sin(at * 0.37) + 0.3 * np.sin(at * 0.011)

    def make(parts):
        import pandas as pd

        for part in parts:
            yield pd.DataFrame({"sig": 1, "ch": 0, "block": part.id, "x": [tone(np.arange(b * size, min(n, (b + 1) * size))) for b in part.id]})

    parts = spark.range(0, -(-n // size), 1, 8).mapInPandas(make, "sig long, ch long, block long, x array<double>")
    found = blocks.k_weighted(parts, 8000)
    rows = found.selectExpr("block", "x[0] as first", "element_at(x, -1) as last").orderBy("block").collect()
    want = tone(np.arange(n))
    for b, a in kernels.k_weighting(8000):
        want = kernels.biquad(want, b, a)
    assert len(rows) == -(-n // size)
    assert max(max(abs(r.first - want[r.block * size]), abs(r["last"] - want[min(n, (r.block + 1) * size) - 1])) for r in rows) < 1e-9


def test_step_between_blocks_counts(spark):
    x = np.concatenate((np.zeros(100), np.ones(50) * 0.5))
    df = channels(spark, {1: [x], 2: [np.array([0.7])], 3: [np.zeros(0)]})
    got = {r.sig: r.step for r in blocks.max_step(blocks.to_blocks(df, 100)).collect()}
    assert got == {1: 1.0, 2: 0.0}
    rows = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(R.normal(size=400))], "sig long, k long, x double")
    arrays = channels(spark, {1: [np.array([r.x for r in rows.orderBy("k").collect()])]})
    assert blocks.max_step(blocks.to_blocks(arrays, 7)).first().step == pytest.approx(levels.max_step(rows).first().step)


def test_coherence_over_block_borders(spark):
    x = R.normal(size=3000)
    signals = {1: (x, x + R.normal(size=3000)), 2: (x, np.zeros(3000)), 3: (x[:64], x[:64]), 4: (x, x)}
    pairs = spark.createDataFrame([(s, a.tolist(), b.tolist()) for s, (a, b) in signals.items()], "sig long, x array<double>, y array<double>")
    want = {r.sig: r.coherence for r in kernels.welch_coherence(pairs, 64, 1000, 100, 400).collect()}
    assert want[2] is None and want[3] is None and want[4] == pytest.approx(1) and 0.3 < want[1] < 0.7
    for size in (64, 160, 4096):
        sides = [blocks.to_blocks(pairs.selectExpr("sig", "0 as ch", f"{c} as x"), size).selectExpr("sig", "block", f"x as {c}") for c in "xy"]
        got = {r.sig: r.coherence for r in blocks.coherence(sides[0].join(sides[1], ["sig", "block"]), size, 64, 1000, 100, 400).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) if want[k] is not None else got[k] is None for k in want)


def drifting(n=4000):
    x, late = R.normal(size=n), np.zeros(n)
    for at in range(0, n, 100):
        shift = at // 20
        part = x[at : at + 100][: max(0, n - at - shift)]
        late[at + shift : at + shift + len(part)] = part
    x[1500:1750] = 0
    return x, late


def test_offsets_are_tracked_block_by_block(spark):
    x, late = drifting()
    pairs = {1: (x, late), 2: (late, x), 3: (x[:50], x[:50])}
    rows = spark.createDataFrame([(s, i, float(a[i]), float(b[i])) for s, (a, b) in pairs.items() for i in range(len(a))], "sig long, i long, a double, b double")
    want = sorted(map(tuple, kernels.track_offsets(rows, 100, 100, 50).collect()))
    assert len(want) > 50
    for size in (37, 450, 10_000):
        cut = [(s, k, a[at : at + size].tolist(), b[at : at + size].tolist()) for s, (a, b) in pairs.items() for k, at in enumerate(range(0, len(a), size))]
        got = sorted(map(tuple, blocks.track_offsets(spark.createDataFrame(cut, "sig long, block long, a array<double>, b array<double>"), 100, 100, 50).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_a_tracker_keeps_little_and_goes_on_from_its_state():
    x, late = drifting()
    whole = list(kernels.tracked(x, late, 100, 100, 50, 0))
    t, found, most = blocks.Tracker(100, 100, 50), [], 0
    for at in range(0, 4000, 130):
        found += t.feed(x[at : at + 130], late[at : at + 130], at + 130 >= 4000)
        t = blocks.Tracker.resumed(t.state())
        most = max(most, len(t.a), len(t.b))
    assert [f[:2] for f in found] == [w[:2] for w in whole] and most < 800


def test_nothing_in_blocks(spark):
    none = spark.createDataFrame([], "sig long, ch long, x array<double>")
    parts = blocks.to_blocks(none, 10)
    assert blocks.k_weighted(parts, 48_000).count() == blocks.max_step(parts).count() == blocks.k_weighted_power(parts, 48_000, 10, 10, 5).count() == 0
