"""Known answers of model runs over stereo stems and of staged runs."""

import pytest

from sigloom.functions import numeric
from sigloom.operators import levels, stages

LEFT, RIGHT = [0.5, -0.25, 0.1], [0.1, 0.3, -0.2]
DDL = "sig long, x array<array<double>>"


def halved():
    return lambda x: x * 0.5


def mono():
    return lambda x: x.mean(0) * 0.5


def broken():
    def run(x):
        raise RuntimeError("no memory")

    return run


def short():
    return lambda x: x[:, :2] * 0.5


def cleaned(spark, load, mode="auto", data=((1, [LEFT, RIGHT]),)):
    return {r.sig: r for r in stages.clean_stems(spark.createDataFrame(list(data), DDL).coalesce(1), load, mode).collect()}


@pytest.mark.parametrize(("load", "mode", "how"), [(halved, "auto", "joint"), (halved, "mid_side", "mid_side"), (mono, "auto", "mid_side"), (mono, "mid_side", "mid_side")])
def test_both_channels_survive_any_model(spark, load, mode, how):
    got = cleaned(spark, load, mode, [(1, [LEFT, RIGHT]), (2, [RIGHT, LEFT])])
    assert [r.strategy for r in got.values()] == [how] * 2
    assert got[1].y[0] == pytest.approx([v / 2 for v in LEFT]) and got[1].y[1] == pytest.approx([v / 2 for v in RIGHT])
    assert got[2].y[0] == pytest.approx(got[1].y[1]) and got[1].residual == pytest.approx(-6.0206, abs=1e-3)


def test_a_lost_channel_is_an_error_when_the_model_is_trusted(spark):
    with pytest.raises(Exception, match="2 channels became 1"):
        cleaned(spark, mono, "joint")
    with pytest.raises(ValueError):
        cleaned(spark, mono, "other")


def test_silent_empty_null_and_failed_stems_stay(spark):
    got = cleaned(spark, broken, data=[(1, [[0.001], [0.0]]), (2, []), (3, None), (4, [LEFT, RIGHT])])
    assert {k: r.strategy for k, r in got.items()} == {1: "skipped", 2: "skipped", 3: "skipped", 4: "failed"}
    assert got[1].y == [[0.001], [0.0]] and got[4].y == [LEFT, RIGHT] and got[2].y == got[3].y == []
    assert all(r.residual == float("-inf") for r in got.values())
    assert cleaned(spark, halved, data=[]) == {}


def test_short_output_is_filled_from_the_stem(spark):
    assert cleaned(spark, short)[1].y == [[0.25, -0.125, 0.1], [0.05, 0.15, -0.2]]
    assert cleaned(spark, halved, data=[(1, [LEFT])])[1].strategy == "joint"


def test_stages_keep_their_tables(spark, tmp_path):
    df = spark.range(4)
    steps = [("v2", lambda d: d.where("id > 0")), ("off", None), ("v3", lambda d: d.where("id > 2"))]
    for _ in range(2):  # a second run takes the place of the first
        got = stages.run_stages(df, steps, str(tmp_path))
        assert list(got) == ["v2", "v3"] and got["v2"].count() == 3
    assert stages.only_one(got["v3"]).first().id == 3
    assert spark.read.parquet(str(tmp_path / "v2")).count() == 3
    for bad in (got["v2"], df.limit(0)):
        with pytest.raises(ValueError):
            stages.only_one(bad)
    with pytest.raises(ValueError):
        stages.run_stages(df, [steps[0], steps[0]], str(tmp_path))


def test_settings_fall_back(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("1",), (" TRUE ",), ("no",), ("2.9",), ("-2.9",), ("1e2",), ("1f",)], "raw string")
    got = df.select(numeric.setting_number(df.raw, 5), numeric.setting_whole(df.raw, 5), numeric.setting_flag(df.raw, True), numeric.setting_text(df.raw, "x")).collect()
    assert [tuple(r) for r in got] == [
        (5.0, 5, True, "x"), (5.0, 5, True, "x"), (1.0, 1, True, "1"), (5.0, 5, True, "TRUE"), (5.0, 5, False, "no"),
        (2.9, 2, False, "2.9"), (-2.9, -2, False, "-2.9"), (100.0, 100, False, "1e2"), (5.0, 5, False, "1f"),
    ]


def test_scaling_by_a_reference(spark):
    ddl = "sig long, x double"
    got = levels.scaled_to(spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None)], ddl), spark.createDataFrame([(1, -0.5), (1, 0.2), (2, 0.0)], ddl))
    assert [r.x for r in got.orderBy("sig").collect()] == [2.0, 1.0, None]
