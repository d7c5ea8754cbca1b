"""WAV files as blocks of samples, a stem set by name, and WAV, JSON and text output."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file suffixes that count as stems.
SUFFIXES = (".wav", ".mp3", ".flac", ".aiff", ".aif", ".ogg", ".m4a")
BLOCK = 65_536


def discover_stems(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, suffix, length) of the audio files right in a folder, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    leaf = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.concat(F.lit("."), F.element_at(F.split(leaf, r"\."), -1)))
    return files.select("path", F.regexp_replace(leaf, r"\.[^.]*$", "").alias("name"), suffix.alias("suffix"), "length").where(F.col("suffix").isin(*SUFFIXES)).orderBy("path")


def wav_header(chunk: bytes) -> tuple[int, int, int, int]:
    """Kind of samples, channels, rate and bits of a format chunk, its name and size included."""
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", chunk, 8)
    if kind == 0xFFFE and int.from_bytes(chunk[4:8], "little") >= 26:
        kind = struct.unpack_from("<H", chunk, 32)[0]
    return kind, channels, rate, bits


def decode_samples(kind: int, bits: int, channels: int, body: bytes) -> np.ndarray:
    """float32 samples (n x channels) of PCM 8, 16, 24, 32 or float data; an incomplete last frame is left out."""
    width = bits // 8
    body = body[: len(body) // (width * channels) * width * channels]
    if kind == 3:
        x = np.frombuffer(body, "<f4" if bits == 32 else "<f8").astype(np.float32)
    elif bits == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    else:
        x = np.frombuffer(body, f"<i{width}").astype(np.float32) / float(1 << (bits - 1))
    return x.reshape(-1, channels)


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and float32 samples (n x channels) of a WAV image; chunk sizes past the end are cut."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = wav_header(data[at : at + 48])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None:
        raise ValueError("no format chunk")
    kind, channels, rate, bits = form
    return rate, decode_samples(kind, bits, channels, body)


def encode_samples(x: np.ndarray, rate: int, bits: int, n: int | None) -> bytes:
    """Samples (n x channels) as PCM of 16 or 24 bits, or float for 32; after the header of a file of n frames if n is given."""
    if bits == 32:
        body, kind = x.astype("<f4").tobytes(), 3
    else:
        top = (1 << (bits - 1)) - 1
        ints = np.clip(np.rint(x.astype(np.float64) * (top + 1)), -top - 1, top).astype("<i4")
        body, kind = ints.reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes(), 1
    if n is None:
        return body
    align = x.shape[1] * bits // 8
    head = struct.pack("<HHIIHH", kind, x.shape[1], rate, rate * align, align, bits)
    return b"RIFF" + struct.pack("<I", min(36 + n * align, 0xFFFFFFFF)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", min(n * align, 0xFFFFFFFF)) + body


def render_wav(x: np.ndarray, rate: int, bits: int = 24) -> bytes:
    """A WAV image of PCM of 16 or 24 bits, or float for 32."""
    x = np.atleast_2d(np.asarray(x, np.float32).T).T
    return encode_samples(x, rate, bits, len(x))


def probe(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sr, channels, n): what the headers of the WAV files right in a folder say. Nothing but headers is read."""
    from sigloom.sources import wav

    return wav.read_headers(spark, folder).select("path", "sr", "channels", "n")


def load_stems(spark: SparkSession, folder: str, mono: bool = False, target_sr: int | None = None, channels: int | None = None) -> DataFrame:
    """(name, sr, channels, n, ch, block, i0, x): WAV stems in blocks; of files with one name the last path counts.

    ``target_sr`` is the rate to convert to, none for the file's own. ``channels`` forces a number of channels whatever the
    file holds: one is the mean, more repeat the mean of a file with another number; ``mono`` is the same as one.
    """
    from sigloom.sources import wav

    wanted = {"channels": channels or (1 if mono else None), "rate": target_sr}
    found = wav.read_blocks(spark, folder, **{k: str(v) for k, v in wanted.items() if v})
    last = wav.read_headers(spark, folder).groupBy("name").agg(F.max("path").alias("path"))
    return found.join(last, ["name", "path"], "left_semi").select("name", "sr", "channels", "n", "ch", "block", "i0", "x")


def samples(blocks: DataFrame) -> DataFrame:
    """(name, ch, i, x): blocks spelled out."""
    return blocks.select("name", "ch", "i0", F.posexplode("x").alias("p", "x")).select("name", "ch", (F.col("i0") + F.col("p")).alias("i"), "x")


def wav_bytes(blocks: DataFrame, bits: int = 24) -> DataFrame:
    """(name, content): one WAV image per stem, made where the stem's blocks meet."""

    def join(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["ch", "block"])
        x = np.stack([np.concatenate([np.asarray(v, np.float32) for v in part.x]) for _, part in pdf.groupby("ch")], 1)
        return pd.DataFrame([{"name": pdf.name.iloc[0], "content": render_wav(x, int(pdf.sr.iloc[0]), bits)}])

    return blocks.groupBy("name").applyInPandas(join, "name string, content binary")


def save_wavs(blocks: DataFrame, folder: str, bits: int = 24) -> DataFrame:
    """Writes a WAV file per stem into a folder that all executors share, and returns (path, bytes) of those written."""

    def write(parts):
        import pandas as pd
        from pyarrow import fs

        for part in parts:
            store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
            store.create_dir(root, recursive=True)
            rows = []
            for name, content in zip(part.name, part.content, strict=True):
                with store.open_output_stream(f"{root}/{name}.wav") as out:
                    out.write(content)
                rows.append((f"{folder}/{name}.wav", len(content)))
            yield pd.DataFrame(rows, columns=["path", "bytes"])

    written = wav_bytes(blocks, bits).mapInPandas(write, "path string, bytes long")
    return blocks.sparkSession.createDataFrame(written.collect(), written.schema)  # one short row a stem


def write_report(reports: DataFrame, path: str, stem: str = "sig") -> None:
    """A JSON object a line for each stem: its name, and under it ``report`` (the other columns) and ``problems`` (a list).

    ``problems`` comes from a column of that name, commas between them, and is empty without one.
    """
    rest = [c for c in reports.columns if c not in (stem, "problems")]
    listed = F.filter(F.split(F.coalesce("problems", F.lit("")), ","), lambda x: x != "") if "problems" in reports.columns else F.array().cast("array<string>")
    entry = F.create_map(F.col(stem).cast("string"), F.struct(F.struct(*rest).alias("report"), listed.alias("problems")))
    reports.select(F.to_json(entry).alias("value")).write.mode("overwrite").text(path)


def report_text(reports: DataFrame) -> DataFrame:
    """(line): each row's columns as ``name=value`` text."""
    pairs = [F.concat_ws("=", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in reports.columns]
    return reports.select(F.concat_ws("  ", *pairs).alias("line"))
