"""Whole restoration runs: stages that a rerun doesn't repeat, stems that fail without stopping the others, and a report.

Every stage's table lies in the run's folder beside a manifest with its schema and row count, written last; a rerun goes on after the
last stage whose manifest, settings and table agree. A stage whose rows have a ``failure`` hands on those without one; the others are
listed in the run's failures.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigloom.operators import layout, repair, spectral, stages, tempo
from sigloom.operators.blocks import to_blocks
from sigloom.sources import wav
from sigloom.sources.interim import exists

FAILURE = "struct<kind:string,message:string>"
#: A cliff falls so many dB within so many Hz, above a floor; the share of energy is that above another frequency; spectra have frames of their own.
CLIFF_DB, CLIFF_HZ, CLIFF_FLOOR_HZ, ENERGY_HZ, LONG_FRAMES = 25.0, 1500.0, 2000.0, 13_000.0, (8192, 2048)


def attempted(rows: DataFrame, columns: list[str], function: Callable, ddl: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, those of ``ddl`` from ``function(*columns)`` for each row, and ``failure``: the kind and message of what it raised, or null."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(parts):
        import pandas as pd

        for part in parts:
            made, failures = [], []
            for row in part[columns].itertuples(index=False):
                try:
                    out = function(*row)
                    made.append(out if isinstance(out, tuple) else (out,))
                    failures.append(None)
                except Exception as e:  # noqa: BLE001 - any failure of one stem is a row of its own
                    made.append((None,) * len(names))
                    failures.append({"kind": type(e).__name__, "message": str(e)})
            yield part[keep].assign(**{n: [m[i] for m in made] for i, n in enumerate(names)}, failure=failures)

    kept = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return rows.select(*dict.fromkeys([*keep, *columns])).mapInPandas(run, f"{kept}, {ddl}, failure {FAILURE}")


@dataclass
class Run:
    """A folder with the tables of a run; ``done`` has them by stage, ``skipped`` the stages that were whole already."""

    spark: SparkSession
    folder: str
    done: dict[str, DataFrame] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    manifests: list[dict] = field(default_factory=list)

    def _manifest(self, name: str) -> dict | None:
        path = f"{self.folder}/{name}/manifest"
        if not exists(self.spark, path):
            return None
        found = self.spark.read.schema("value string").text(path).collect()  # one short row
        return json.loads(found[0][0]) if len(found) == 1 else None

    def _whole(self, name: str, settings: str, after: str | None) -> DataFrame | None:
        m = self._manifest(name)
        if m is None or (m["settings"], m["after"]) != (settings, after) or not exists(self.spark, f"{m['path']}/_SUCCESS"):
            return None
        table = self.spark.read.schema(StructType.fromJson(m["schema"])).parquet(m["path"])
        if table.count() != m["rows"] + m["failed"]:
            return None
        self.manifests.append(m)
        self.skipped.append(name)
        return table

    def stage(self, name: str, make: Callable[[], DataFrame], settings: str = "", key: str = "name") -> DataFrame:
        """The rows of a stage that didn't fail; made now unless an earlier run left them whole, after the same stage and with the same settings."""
        if name in self.done:
            raise ValueError(f"two stages are named {name}")
        table = self._whole(name, settings, self.manifests[-1]["id"] if self.manifests else None)
        if table is None:
            rows, id_ = make(), uuid.uuid4().hex
            failed = F.col("failure").isNotNull() if "failure" in rows.columns else F.lit(False)
            seen, path = Observation(f"{name}-{id_}"), f"{self.folder}/{name}/data-{id_}"
            rows.observe(seen, F.count_if(~failed).alias("rows"), F.count_if(failed).alias("failed")).write.parquet(path)
            table = self.spark.read.parquet(path)
            m = {"stage": name, "id": id_, "after": self.manifests[-1]["id"] if self.manifests else None, "settings": settings, "path": path, "key": key, **seen.get, "schema": json.loads(table.schema.json())}
            self.spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}/manifest")
            self.manifests.append(m)
        self.done[name] = table.where("failure is null").drop("failure") if "failure" in table.columns else table
        return self.done[name]

    def failures(self) -> DataFrame:
        """(stage, key, kind, message) of every row that failed."""
        found = self.spark.createDataFrame([], "stage string, key string, kind string, message string")
        for m in self.manifests:
            if m["failed"]:
                rows = self.spark.read.parquet(m["path"]).where("failure is not null")
                found = found.unionByName(rows.select(F.lit(m["stage"]).alias("stage"), F.col(m["key"]).cast("string").alias("key"), "failure.kind", "failure.message").distinct())
        return found

    def summary(self) -> DataFrame:
        """(line): a line a stage, in order."""
        rows = [(k, m["stage"], m["rows"], m["failed"], m["stage"] in self.skipped) for k, m in enumerate(self.manifests)]
        df = self.spark.createDataFrame(rows, "k int, stage string, rows long, failed long, kept boolean")
        return df.orderBy("k").select(F.format_string("%-12s %8d rows  %4d failed%s", "stage", "rows", "failed", F.when(F.col("kept"), "  (from an earlier run)").otherwise("")).alias("line"))


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    """(name, pos, sr, ch, x): the WAV stems of a folder, a row a channel; a file that can't be read is a failure."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").endswith(".wav")).select("path").withColumn("name", F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1))

    def read(path):
        store, place = wav.opened(path)
        with store.open_input_file(place) as file:
            head = wav.Header(file)
            return head.rate, head.samples(file, 0, head.n).T.astype(float).tolist()

    stems = attempted(files, ["path"], read, "sr int, x array<array<double>>", ["path", "name"])
    pos = F.expr("dense_rank() over (order by path)")
    names = files.select("path", pos.alias("pos"))  # one short row a file
    rows = stems.join(F.broadcast(names), "path").select("name", "pos", "sr", F.posexplode_outer("x").alias("ch", "x"), "failure")
    return rows.withColumn("ch", F.col("ch").cast("long"))


def spectrum_figures(stems: DataFrame, when: str, n_fft: int, hop: int, floor_hz: float) -> DataFrame:
    """(name, cliff_when, energy_when): where the spectrum of a stem's mean channel breaks off, and the share of it above ``floor_hz``."""
    add = lambda a, b: F.zip_with(a, b, lambda u, v: u + F.coalesce(v, F.lit(0.0)))
    both = stems.groupBy("name", "sr").agg(F.collect_list("x").alias("v"))
    total = F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.get("v", F.lit(0)), add)
    mono = both.select("name", "sr", F.xxhash64("name").alias("sig"), F.transform(total, lambda x: x / F.size("v")).alias("x"))
    found = None
    for sr in [r.sr for r in stems.select("sr").distinct().collect()]:  # some rates at most
        spec = spectral.percentile_spectrum(spectral.dft(spectral.stft(mono.where(F.col("sr") == sr), n_fft, hop), n_fft, sr, window=spectral.hann(n_fft)))
        one = spectral.spectral_cliff(spec, max(1, int(CLIFF_HZ * n_fft / sr)), CLIFF_FLOOR_HZ, CLIFF_DB).join(spectral.energy_above(spec, floor_hz), "stem", "full")
        found = one if found is None else found.unionByName(one)
    names = mono.select("name", F.col("sig").alias("stem"))
    if found is None:
        return names.select("name", F.lit(None).cast("double").alias(f"cliff_{when}"), F.lit(None).cast("double").alias(f"energy_{when}"))
    return names.join(found, "stem", "left").select("name", F.col("cliff_hz").alias(f"cliff_{when}"), F.col("pct").alias(f"energy_{when}"))


def restore(
    spark: SparkSession, folder: str, out: str, work: str, beats: DataFrame | None = None, keywords: tuple[str, ...] = ("drum",), denoiser: Callable | None = None,
    extender: Callable | None = None, n_fft: int = 2048, hop: int = 512, frames: tuple[int, int] = LONG_FRAMES, floor_hz: float = ENERGY_HZ, bits: int = 24, settings: str = "",
) -> tuple[DataFrame, Run]:
    """Restores the WAV stems of a folder into ``out`` as ``name_restored.wav``, and returns a report, a row a stem, and the run.

    Steps that get nothing are left out: ``beats`` (name, t) for one tempo grid of all stems, ``denoiser()`` and ``extender()``, which load
    a model (channels x samples to the same) once a task. A stem that fails at a step is in the run's failures, the others come out; so is
    one whose channels change. Silent stems pass. ``work`` is a folder that all executors share; the same call on it goes on where a run ended.
    """
    run = Run(spark, work)
    stems = run.stage("loaded", lambda: loaded(spark, folder), f"{folder} {settings}")
    before = run.stage("measured", lambda: spectrum_figures(stems, "before", *frames, floor_hz).join(stems.groupBy("name").agg(F.count("*").alias("channels_in"), F.max("sr").alias("sr"), F.max(F.size("x")).alias("n_in")), "name"), f"{frames} {floor_hz}")
    notes = before.select("name")
    if beats is not None:
        rates = [r.sr for r in stems.select("sr").distinct().collect()]

        def even():
            parts = [
                tempo.correct_tempo(stems.where(F.col("sr") == sr).select(F.lit(1).alias("song"), "name", "pos", "ch", "x"), beats.select(F.lit(1).alias("song"), "name", "t"), sr, keywords, n_fft, hop).withColumn("sr", F.lit(sr))
                for sr in rates
            ]
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            return whole.select("name", "sr", "ch", F.col("y").alias("x"), F.col("status").alias("tempo"))

        stems = run.stage("tempo", even, str(keywords)) if rates else stems
        if rates:
            notes = notes.join(stems.groupBy("name").agg(F.max("tempo").alias("tempo")), "name", "left")
    if denoiser:

        def clean():
            whole = stems.groupBy("name", "sr").agg(F.sort_array(F.collect_list(F.struct("ch", "x"))).alias("v")).select("name", "sr", F.xxhash64("name").alias("sig"), F.col("v.x").alias("x"))
            done = stages.clean_stems(whole, denoiser).join(whole.select("sig", "name", "sr"), "sig")
            failed = F.when(F.col("strategy") == "failed", F.struct(F.lit("RuntimeError").alias("kind"), F.lit("the denoiser gave up").alias("message")))
            return done.select("name", "sr", "strategy", "residual", F.posexplode("y").alias("ch", "x"), failed.alias("failure")).withColumn("ch", F.col("ch").cast("long"))

        stems = run.stage("denoise", clean)
        notes = notes.join(stems.groupBy("name").agg(F.max("strategy").alias("strategy"), F.max("residual").alias("residual")), "name", "left")
    if extender:

        def extend():
            whole = stems.groupBy("name", "sr").agg(F.sort_array(F.collect_list(F.struct("ch", "x"))).alias("v")).select("name", "sr", F.col("v.x").alias("x"))
            made = attempted(whole, ["x"], extended(extender), "y array<array<double>>", ["name", "sr"])
            return made.select("name", "sr", F.posexplode_outer("y").alias("ch", "x"), "failure").withColumn("ch", F.col("ch").cast("long"))

        stems = run.stage("bandwidth", extend)
    channels = stems.groupBy("name").agg(F.count("*").alias("channels")).withColumnRenamed("name", "sig")
    wrong = layout.check_stage(before.select(F.col("name").alias("sig"), F.col("channels_in").alias("channels")), channels).where("problem = 'channels'").select(F.col("sig").alias("name"), "problem")
    failure = F.when(F.col("problem").isNotNull(), F.struct(F.lit("IntegrityError").alias("kind"), F.lit("the number of channels changed").alias("message")))
    stems = run.stage("checked", lambda: stems.select("name", "sr", "ch", "x").join(F.broadcast(wrong), "name", "left").withColumn("failure", failure).drop("problem"))
    after = run.stage("report", lambda: spectrum_figures(stems, "after", *frames, floor_hz).join(stems.groupBy("name").agg(F.count("*").alias("channels_out"), F.max(F.size("x")).alias("n_out")), "name"))
    save(stems, out, "_restored", bits)
    report = before.join(after, "name").join(notes, "name", "left").withColumn("output", F.concat(F.lit(f"{out}/"), "name", F.lit("_restored.wav")))
    return report, run


def extended(load: Callable) -> Callable:
    """A function of rows of channels that loads its model when it is first called in a task."""
    held: list = []

    def one(x):
        if not held:
            held.append(load())
        x = np.stack([np.asarray(c, float) for c in x])
        return np.atleast_2d(held[0](x)).tolist() if np.abs(x).max(initial=0.0) >= 10 ** (stages.SILENT_DB / 20) else x.tolist()

    return one


def save(stems: DataFrame, out: str, suffix: str, bits: int = 24) -> None:
    """A WAV file for each stem (name, sr, ch, x), all or none; channels end with the shortest one."""
    sizes = stems.groupBy("name").agg(F.count("*").cast("int").alias("channels"), F.min(F.size("x")).cast("long").alias("n"))
    rows = stems.join(sizes, "name").select(F.concat("name", F.lit(suffix)).alias("name"), "sr", "channels", "n", F.col("ch").cast("int").alias("ch"), F.expr("slice(x, 1, int(n))").alias("x"))
    keyed = rows.withColumn("sig", F.xxhash64("name"))
    parts = to_blocks(keyed.select("sig", F.col("ch").cast("long").alias("ch"), "x"))
    named = parts.join(keyed.select("sig", "name", "sr", "channels", "n").distinct(), "sig")
    wav.write_stems(named.withColumn("ch", F.col("ch").cast("int")), out, bits)


def restore_from_stem(spark: SparkSession, folder: str, out: str, work: str, notes: DataFrame, repaired: DataFrame, rate: int = repair.RATE, bits: int = 24, **more) -> tuple[DataFrame, Run]:
    """Repairs the one stem of a folder (``out/v2/name_v2.wav``), restores the repaired one (``out/v3/name_restored.wav``), and returns the report.

    notes and repaired (k, onset, dur, pitch); ``more`` goes to :func:`restore`. Both files are kept. Anything but one stem fails.
    """
    run = Run(spark, f"{work}/v2")
    stems = run.stage("loaded", lambda: loaded(spark, folder), folder)
    stages.only_one(stems.select("name").distinct())
    keyed = stems.withColumn("sig", F.lit(1).cast("long"))
    fixed = run.stage("enhanced", lambda: repair.enhance(keyed.select("sig", "ch", "sr", "x"), notes.withColumn("sig", F.lit(1).cast("long")), repaired.withColumn("sig", F.lit(1).cast("long")), rate).join(stems.select("ch", "name"), "ch"))
    save(fixed.select("name", "sr", "ch", "x"), f"{out}/v2", "_v2", bits)
    save(fixed.select("name", "sr", "ch", "x"), f"{work}/v3_input-{run.manifests[-1]['id']}", "", 32)
    report, second = restore(spark, f"{work}/v3_input-{run.manifests[-1]['id']}", f"{out}/v3", f"{work}/v3", bits=bits, **more)
    report = stages.only_one(report)
    told = fixed.groupBy("name").agg(F.max("status").alias("repair"), F.max("before").alias("risk_before"), F.max("after").alias("risk_after"))
    return report.join(told, "name").withColumn("version_2", F.concat(F.lit(f"{out}/v2/"), "name", F.lit("_v2.wav"))), second
