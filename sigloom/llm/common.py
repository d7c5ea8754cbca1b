"""Helpers shared by the training-data operators."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word in :func:`words_of`: ASCII other than letters and digits. Capitals become small letters.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Bytes of the rows that a Python function gets at a time, on average over their batch.
SLICE_BYTES = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_sigloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, "sigloom_pkg.zip")
    with open(path, "wb") as out:
        out.write(data.getvalue())
    sc.addPyFile(path)  # the driver serves the file; executors fetch it
    sc._sigloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, in the one that spark.checkpoint.dir names.

    Where that setting is missing a temporary folder takes its place, but only if the driver does all the work itself.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sigloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again. Smaller than a checkpoint, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stored` that nothing will read again."""
    for table in tables:
        if files := table.inputFiles():
            sc = table.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def neutral(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns named c0, c1 and so on, the new names by the old ones, and the way back.

    Columns that an operator adds meanwhile can't clash with those of ``df``; the way back leaves them out.
    """
    names, plain = df.columns, [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*plain), dict(zip(names, plain, strict=True)), lambda out: out.select(*plain).toDF(*names)


def map_columns(
    df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., list[list]]], schema: pa.Schema, ddl: str,
    keep: list[str] = (),
) -> DataFrame:
    """Runs a Python function over Arrow batches.

    ``make()`` is called once per partition and returns ``f(*columns) -> list of output columns``; the input
    columns come as Python lists. ``keep`` columns pass through unchanged, before the new ones, whose names they may not
    have. A call gets at most 1024 rows, and fewer if they are long, but one at least.
    """
    ship_package(df.sparkSession)
    inputs, keep = list(inputs), list(keep)
    if clash := {c.lower() for c in keep} & {c.lower() for c in schema.names}:
        raise ValueError(f"columns to keep have the names of new ones: {sorted(clash)}")
    picked = list(dict.fromkeys([*keep, *inputs]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            step = max(1, min(1024, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = f(*(part.column(picked.index(c)).to_pylist() for c in inputs))
                arrays = [part.column(picked.index(c)) for c in keep]
                arrays += [pa.array(x, type=t.type) for x, t in zip(out, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *schema.names])

    kept = ", ".join(f"`{c}` {t}" for c, t in df.select(*(F.col(f"`{c}`") for c in keep)).dtypes)
    return df.select(*(F.col(f"`{c}`") for c in picked)).mapInArrow(run, f"{kept}, {ddl}" if kept else ddl)


def id_remainder(doc_id: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % n


def hash_threshold(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th smallest distinct xxhash64 of a column: keeping rows up to it keeps at most k distinct values.

    The sample doesn't depend on partitioning, and only one number reaches the driver. None: the table is empty.
    """
    h = df.select(F.xxhash64(F.col(column)).alias("h")).distinct().orderBy("h").limit(k)
    return h.agg(F.max("h")).first()[0]
