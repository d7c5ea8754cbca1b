"""WAV files read and written by the data source: headers alone, stretches of long files, whole jobs or nothing."""

import os
import pickle
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import kernels
from sigloom.plans import catalogue
from sigloom.sources import audio, wav
from tests.compare import same


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(8)
    signals = {"one": rng.normal(size=(5000, 2)) * 0.1, "two more": rng.normal(size=(1234, 1)) * 0.1, "none": np.zeros((0, 2))}
    for (name, x), bits, rate in zip(signals.items(), (24, 32, 16), (48_000, 44_100, 8000), strict=True):
        (tmp_path / f"{name}.wav").write_bytes(audio.render_wav(x, rate, bits))
    (tmp_path / "notes.txt").write_text("no audio")
    (tmp_path / ".hidden.wav").write_text("no audio")
    return str(tmp_path), signals


def whole(df):
    out = {}
    for r in df.orderBy("name", "ch", "block").collect():
        out.setdefault((r.name, r.ch), []).extend(r.x)
    return {k: np.array(v) for k, v in out.items()}


def test_headers_of_huge_files_take_some_bytes(spark, folder):
    path, _ = folder
    body = 8 << 30  # a sparse file: only the header is there to read
    with open(f"{path}/huge.wav", "wb") as f:
        extra = b"LIST" + struct.pack("<I", 5000) + b"\0" * 5000
        f.write(b"RIFF" + struct.pack("<I", 36) + b"WAVE" + extra + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 48_000, 192_000, 4, 16) + b"data" + struct.pack("<I", 0xFFFFFFF0))
        f.truncate(body)
    with open(f"{path}/huge.wav", "rb") as f:

        class File:
            def size(self):
                return body

            def read_at(self, n, at):
                f.seek(at)
                return f.read(n)

        assert wav.Header(File()).bytes_read < 4096
    got = {r.name: (r.sr, r.channels, r.n) for r in wav.read_headers(spark, path).collect()}
    assert got == {"one": (48_000, 2, 5000), "two more": (44_100, 1, 1234), "none": (8000, 2, 0), "huge": (48_000, 2, 0xFFFFFFF0 // 4)}
    assert {(r.path.rsplit("/", 1)[1], r.sr) for r in audio.probe(spark, path).collect()} >= {("one.wav", 48_000), ("huge.wav", 48_000)}


def test_a_file_is_read_by_several_tasks(spark, folder):
    path, signals = folder
    df = wav.read_blocks(spark, path, block="700", stretch="9000")
    assert df.rdd.getNumPartitions() > 3
    got = whole(df)
    assert {k for k in got} == {("one", 0), ("one", 1), ("two more", 0), ("none", 0), ("none", 1)}
    for name, x in signals.items():
        for c in range(x.shape[1]):
            assert got[name, c].shape == (len(x),) and (not len(x) or np.abs(got[name, c] - x[:, c]).max() < 1e-6)
    assert df.where("name = 'two more'").select("block", "i0").distinct().count() == 2


def test_filters_leave_files_closed(spark, folder):
    path, _ = folder
    reader = wav.WavReader({"path": path}, wav.read_blocks(spark, path).schema)
    assert list(reader.pushFilters([wav.EqualTo(("name",), "two more"), wav.In(("sr",), (1,))])) == [wav.In(("sr",), (1,))]
    assert [p.path.rsplit("/", 1)[1] for p in reader.partitions()] == ["two more.wav"]


def test_rates_and_channels_by_block(spark, folder):
    path, signals = folder
    got = whole(wav.read_blocks(spark, path, rate="22050", channels="1", block="500"))
    want = kernels.resample_array(signals["one"].mean(1), 48_000, 22_050)
    assert got["one", 0].shape == want.shape and np.abs(got["one", 0] - want).max() < 1e-5 and set(got) == {("one", 0), ("two more", 0), ("none", 0)}


def test_stems_come_back_from_what_is_written(spark, folder, tmp_path):
    path, signals = folder
    out = f"{tmp_path}/out"
    wav.write_stems(wav.read_blocks(spark, path, block="700"), out)
    assert sorted(os.listdir(out)) == ["none.wav", "one.wav", "two more.wav"]
    got = whole(wav.read_blocks(spark, out))
    assert all(np.abs(got[n, c] - x[:, c]).max() < 1e-6 for n, x in signals.items() if len(x) for c in range(x.shape[1]))
    assert open(f"{out}/one.wav", "rb").read() == open(f"{path}/one.wav", "rb").read()


def test_a_failed_write_leaves_no_file(spark, folder, tmp_path):
    path, _ = folder
    out = f"{tmp_path}/out"
    bad = wav.read_blocks(spark, path, block="700").withColumn("x", F.when((F.col("name") == "two more") & (F.col("block") == 1), F.raise_error(F.lit("broken")).cast("array<float>")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken"):
        wav.write_stems(bad.coalesce(1), out)
    assert not os.path.exists(out) or os.listdir(out) == []
    with pytest.raises(Exception, match="every channel"):
        wav.write_stems(wav.read_blocks(spark, path).where("ch = 1 or name <> 'one'"), out)
    assert not os.path.exists(out) or os.listdir(out) == []


def test_an_empty_folder(spark, tmp_path):
    assert wav.read_headers(spark, str(tmp_path)).count() == 0 and audio.load_stems(spark, str(tmp_path)).count() == 0


def test_short_files_share_a_task(spark, tmp_path):
    """With a partition a file, tasks and their results on the driver grew with the number of files."""
    rng = np.random.default_rng(3)
    signals = {f"s {k:03}": rng.normal(size=(20 + k % 7, 1 + k % 2)) * 0.1 for k in range(300)} | {"s 150 long": rng.normal(size=(90_000, 2)) * 0.1}
    for name, x in signals.items():
        (tmp_path / f"{name}.wav").write_bytes(audio.render_wav(x, 48_000, 24))
    for path in (str(tmp_path), f"file://{tmp_path}"):
        df = wav.read_blocks(spark, path, stretch="200000")
        parts = wav.WavReader({"path": path, "stretch": "200000", "tasks": "4"}, df.schema).partitions()
        # 20 MB for opening 301 files, of which 200,000 bytes make a partition; the long one is in three stretches.
        assert df.rdd.getNumPartitions() == len(parts) < 110 and sum(len(p.parts) for p in parts) == 303
        assert wav.read_blocks(spark, path).rdd.getNumPartitions() <= 5 and wav.read_headers(spark, path).rdd.getNumPartitions() <= 5
        got = whole(df)
        assert set(got) == {(n, c) for n, x in signals.items() for c in range(x.shape[1])}
        assert all(got[n, c].shape == (len(x),) and np.abs(got[n, c] - x[:, c]).max() < 1e-6 for n, x in signals.items() for c in range(x.shape[1]))
        assert {(r.path, r.name, r.n) for r in wav.read_headers(spark, path).collect()} == {(f"{path}/{n}.wav", n, len(x)) for n, x in signals.items()}
    assert catalogue.queries()["wav_source"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() <= 5


def test_a_task_holds_a_batch_and_not_its_partition(spark, folder, monkeypatch):
    path, signals = folder
    schema = wav.read_blocks(spark, path).schema
    reader = wav.WavReader({"path": path, "block": "700"}, schema)
    monkeypatch.setattr(wav, "SAMPLES_AT_ONCE", 2000)
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert [b.schema.names for b in batches] == [schema.names] * len(batches) and len(batches) > 5
    assert max(sum(map(len, b.column("x").to_pylist())) for b in batches) < 2700
    assert sum(len(x) for b in batches for x in b.column("x").to_pylist()) == sum(x.size for x in signals.values())


def test_what_a_write_tells_the_driver(tmp_path):
    """The names alone, as many as there are files."""
    schema = wav.WavSource({}).schema()
    writer = wav.WavWriter({"path": str(tmp_path / "out")}, [type("Field", (), {"name": c.split()[0]}) for c in schema.split(", ")])
    rows = [{"name": f"{k:03}", "sr": 8000, "channels": 1, "n": 2, "ch": 0, "block": 0, "x": [0.0, 0.5]} for k in range(400)]
    message = writer.write(iter(rows))
    assert not [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")] and len(pickle.dumps(message)) < 400 * 12
    writer.commit([message, None])
    assert sorted(os.listdir(tmp_path / "out")) == [f"{k:03}.wav" for k in range(400)]


def test_repeated_and_lone_vectors(spark, tmp_path):
    """Every vector whose pair has an odd one comes back, as the SQL says: repeated ones, unequal numbers of them and lone odd ones."""
    ids = [0, 1, 4, 4, 7, 8, 8, 9, 9, 10, 10, 11, 12, 13, 13, 13, 16, 21, 21]
    rng = np.random.default_rng(5)
    vectors = [(k, [float(v) for v in np.float32(rng.normal(size=64) * 0.2)], 1) for k in ids]
    vectors[6] = vectors[5]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    same(catalogue.queries()["wav_source"](spark, str(tmp_path)).toPandas(), con.execute(catalogue.oracle_sql()["wav_source"]).df())
