"""The streaming tracker: equal to the batch form after a restart, with blocks out of order, repeated, and signals that just stop."""

import time

import numpy as np
import pytest

from sigloom.operators import kernels
from sigloom.streaming import tracker

SCHEMA = "sig long, block long, a array<double>, b array<double>, last boolean"
SIZES = (100, 100, 50)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def drifting(seed, n=2000):
    r = np.random.default_rng(seed)
    x, late = r.normal(size=n), np.zeros(n)
    for at in range(0, n, 100):
        shift = at // 20
        part = x[at : at + 100][: max(0, n - at - shift)]
        late[at + shift : at + shift + len(part)] = part
    return x, late


def cut(sig, a, b, size=170, ends=True):
    starts = range(0, len(a), size)
    return [(sig, k, a[at : at + size].tolist(), b[at : at + size].tolist(), ends and at + size >= len(a)) for k, at in enumerate(starts)]


def run(spark, folder, checkpoint, out, idle=None):
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    found = tracker.track_offsets(rows, *SIZES, idle)
    query = found.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append")
    if not idle:
        started = query.trigger(availableNow=True).start()
        assert started.awaitTermination(120)
        return
    started = query.trigger(processingTime="1 second").start()
    deadline = time.time() + 60
    while time.time() < deadline and started.isActive and (not started.recentProgress or not started.recentProgress[-1].sink.numOutputRows):
        time.sleep(0.5)
    time.sleep(2)
    started.stop()


def test_it_equals_the_batch_form_over_a_restart(rocks, tmp_path):
    spark = rocks
    pairs = {s: drifting(s) for s in (1, 2, 3)}
    rows = spark.createDataFrame([(s, i, float(a[i]), float(b[i])) for s, (a, b) in pairs.items() for i in range(len(a))], "sig long, i long, a double, b double")
    want = sorted(map(tuple, kernels.track_offsets(rows, *SIZES).collect()))
    one, two, three = (cut(s, *pairs[s], ends=s != 3) for s in (1, 2, 3))
    folder, checkpoint, out = (f"{tmp_path}/{n}" for n in ("in", "checkpoint", "out"))
    write = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    write(one[:5] + two[4:6] + three[:7])
    run(spark, folder, checkpoint, out)
    early = spark.read.parquet(out).count()
    assert early > 0 and spark.read.parquet(out).where("sig = 2").isEmpty()
    write(one[3:] + two[6:] + three[7:])  # again, and the rest
    write(two[:4])
    run(spark, folder, checkpoint, out)
    got = sorted(map(tuple, spark.read.parquet(out).where("sig < 3").collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want if w[0] < 3] and np.allclose([g[3] for g in got], [w[3] for w in want if w[0] < 3])


def test_a_signal_that_stops_is_closed_by_a_timer(rocks, tmp_path):
    a, b = drifting(5, 260)
    folder, checkpoint, out = (f"{tmp_path}/{n}" for n in ("in", "checkpoint", "out"))
    rocks.createDataFrame(cut(5, a, b, 260, ends=False), SCHEMA).coalesce(1).write.parquet(folder)
    run(rocks, folder, checkpoint, out, idle=500)
    want = list(kernels.tracked(a, b, *SIZES, 0))
    got = sorted(map(tuple, rocks.read.schema(tracker.WINDOWS).parquet(out).collect()))
    assert [g[1:3] for g in got] == [w[:2] for w in want] and len(got) == 2
