"""The repair chain on synthetic stems with known damage: only what gets better is kept, and only the damaged stretch changes."""

import numpy as np
import pytest

from sigloom.operators import repair

SR, RATE = 32_000, 16_000
R = np.random.default_rng(9)
NOTES = "sig long, k long, onset double, dur double, pitch long"


def tune(damage=None, seconds=8):
    """A note of half a second after the other, two channels unlike in level; inside the damage there is noise."""
    t = np.arange(SR * seconds) / SR
    pitch = [60, 62, 64, 65]
    x, notes = np.zeros(len(t)), []
    for k in range(2 * seconds):
        here = (t >= k / 2) & (t < k / 2 + 0.48)
        p = pitch[k % 4]
        notes.append((k, k / 2, 0.48, p))
        local = t[here] - k / 2
        x[here] = 0.3 * np.sin(2 * np.pi * 440 * 2 ** ((p - 69) / 12) * local) * np.minimum(1, 40 * np.minimum(local, 0.48 - local))
    x += R.normal(size=len(t)) * 1e-5
    if damage:
        here = (t >= damage[0]) & (t < damage[1])
        x[here] = R.normal(size=here.sum()) * 0.1
    return np.stack([x, 0.5 * x]), notes


@pytest.fixture(scope="module")
def result(spark):
    good, notes = tune()
    bad, _ = tune((3.0, 5.0))
    stems = {1: bad, 2: good, 3: bad, 4: bad}
    rows = [(s, c, SR, row.tolist()) for s, x in stems.items() for c, row in enumerate(x)]
    heard = [(1, *n) for n in notes if not 3 <= n[1] < 5] + [(2, *n) for n in notes] + [(4, *n) for n in notes]
    wanted = [(s, *n) for s in (1, 2, 3) for n in notes]  # for 4 nothing to play: silence, whose flatness is that of the floor
    df = lambda r: spark.createDataFrame(r, NOTES)
    out = repair.enhance(spark.createDataFrame(rows, "sig long, ch long, sr int, x array<double>"), df(heard), df(wanted), RATE).collect()
    return stems, {(r.sig, r.ch): r for r in out}


def test_a_damaged_stretch_is_played_again(result):
    stems, got = result
    r = got[1, 0]
    assert r.status == "repaired" and r.after < 0.5 * r.before and r.before > 0.5
    assert 2.4 < r.start < 3.1 and 4.9 < r.end < 5.6 and len(r.x) == stems[1].shape[1]
    x, clean = np.array(r.x), tune()[0][0]
    far = np.abs(np.arange(len(x)) / SR - 4) > 2
    assert np.abs(x[far] - stems[1][0][far]).max() < 1e-3
    spectrum = lambda v: np.abs(np.fft.rfft(v[int(3.6 * SR) : int(3.95 * SR)]))
    assert abs(np.argmax(spectrum(x)) - np.argmax(spectrum(clean))) <= 2


def test_every_channel_gets_the_same_change(result):
    stems, got = result
    change = [np.array(got[1, c].x) - stems[1][c] for c in (0, 1)]
    quiet = (np.abs(np.array(got[1, 0].x)) < 1) & (np.abs(np.array(got[1, 1].x)) < 1)
    assert np.abs(change[0] - change[1])[quiet].max() < 1e-9 and np.abs(change[0]).max() > 0.05


def test_what_is_sound_or_cannot_be_bettered_stays(result):
    stems, got = result
    assert got[3, 0].status == "no donors" and got[3, 0].x == stems[3][0].tolist()
    assert got[4, 0].status == "not better" and got[4, 0].x == stems[4][0].tolist() and got[4, 0].after >= got[4, 0].before
    assert got[2, 1].status in ("unflagged", "not better") and got[2, 1].x == stems[2][1].tolist()


def test_pieces_add_up_by_position(spark):
    pieces = spark.createDataFrame([(1, 0, 0, [0.5] * 4), (1, 1, 2, [0.25] * 4), (2, 0, 1, [2.0, -4.0])], "sig long, k long, place long, y array<double>")
    windows = spark.createDataFrame([(1, 7), (2, 4), (3, 0), (4, 2)], "sig long, size int")
    got = {}
    for r in repair.rendered(pieces, windows).orderBy("sig", "j").collect():
        got.setdefault(r.sig, []).append(r.p)
    assert got[1] == [0.5, 0.5, 0.75, 0.75, 0.25, 0.25, 0] and got[2] == pytest.approx([0, 0.475, -0.95, 0]) and got[4] == [0, 0] and 3 not in got


def test_donors_change_pitch_and_length():
    t = np.arange(8000) / RATE
    y = repair.reshaped(np.sin(2 * np.pi * 400 * t), 12, 0.25, RATE)
    assert abs(len(y) - 4000) <= 1
    assert abs(np.argmax(np.abs(np.fft.rfft(y[500:3500], 16_000))) - 800) < 8
    short = np.sin(2 * np.pi * 1000 * np.arange(600) / RATE)
    assert len(repair.reshaped(short, 5, 0.05, RATE)) == 800


def test_nothing_to_repair(spark):
    none = spark.createDataFrame([], "sig long, ch long, sr int, x array<double>")
    assert repair.enhance(none, spark.createDataFrame([], NOTES), spark.createDataFrame([], NOTES)).count() == 0
