"""WAV files as a data source: ``spark.read.format("wav_blocks")`` and ``df.write.format("wav_blocks")``.

A long file is cut into stretches and short files share a partition, so tasks grow with the bytes and not with the number of files.
Each task seeks to what it needs: only headers if no sample columns are asked for, and otherwise only its own blocks. A written
file appears under its name when the whole job is committed.
Paths may have any scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from sigloom.operators.kernels import resample_range
from sigloom.sources.audio import BLOCK, decode_samples, encode_samples, wav_header

HEADER = "path string, name string, sr int, channels int, n long"
SAMPLES = "ch int, block long, i0 long, x array<float>"
#: Bytes of a file that make a partition, those of a header that are read at once, and those that opening a file counts for.
STRETCH, HEAD, OPENING = 64 << 20, 512, 64 << 10
#: Samples and rows that are handed to Spark at once.
SAMPLES_AT_ONCE, ROWS_AT_ONCE = 1 << 20, 10_000


def opened(path: str):
    """The file system of a path or address, and the place in it. Names may hold spaces."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/%@"))


def stem(path: str) -> str:
    leaf = path.rsplit("/", 1)[-1]
    return leaf.rsplit(".", 1)[0] if "." in leaf else leaf


class Header:
    """The format of an open file and where its samples are; chunk by chunk, so that no sample is read."""

    def __init__(self, file):
        size, at, self.form = file.size(), 12, None
        data = file.read_at(min(HEAD, size), 0)
        self.bytes_read = len(data)
        if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
            raise ValueError("not a WAV file")
        while at + 8 <= size:
            part = data[at : at + 48] if at + 48 <= len(data) else file.read_at(min(48, size - at), at)
            self.bytes_read += 0 if at + 48 <= len(data) else len(part)
            name, length = part[:4], int.from_bytes(part[4:8], "little")
            if name == b"fmt ":
                self.form = wav_header(part)
            elif name == b"data" and self.form:
                self.start = at + 8
                self.kind, self.channels, self.rate, self.bits = self.form
                self.width = self.channels * self.bits // 8
                self.n = min(length, size - at - 8) // self.width
                return
            at += 8 + length + length % 2
        raise ValueError("no format or data chunk")

    def samples(self, file, lo: int, hi: int) -> np.ndarray:
        """Samples lo to hi, a column a channel."""
        return decode_samples(self.kind, self.bits, self.channels, file.read_at((hi - lo) * self.width, self.start + lo * self.width))


@dataclass
class Stretches(InputPartition):
    """Stretches (leaf, lo, hi) of files that lie right in one folder."""

    folder: str
    parts: list

    @property
    def path(self) -> str:
        """The first file."""
        return self.folder + self.parts[0][0]


class WavReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.folder, self.schema, self.names = options["path"], schema, [f.name for f in schema]
        self.samples = bool(set(self.names) & {"ch", "block", "i0", "x"})
        self.block = int(options.get("block", BLOCK))
        self.stretch = int(options.get("stretch", STRETCH))
        self.tasks = int(options.get("tasks", 1))
        self.channels = int(options["channels"]) if options.get("channels") else None
        self.rate = int(options["rate"]) if options.get("rate") else None
        self.only: set[str] | None = None

    def pushFilters(self, filters):
        """Files that a filter on path or name leaves out aren't opened."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute in (("path",), ("name",)):
                files = {p for p in self._files() if (p if f.attribute == ("path",) else stem(p)) in wanted}
                self.only = files if self.only is None else self.only & files
            else:
                yield f

    def _files(self) -> dict[str, int]:
        from pyarrow import fs

        store, place = opened(self.folder)
        found = store.get_file_info(fs.FileSelector(place)) if store.get_file_info(place).type == fs.FileType.Directory else [store.get_file_info(place)]
        scheme = self.folder.split("://")[0] + "://" if "://" in self.folder else ""
        files = {scheme + f.path: f.size for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".wav") and not f.base_name.startswith((".", "_"))}
        return dict(sorted(files.items()))

    def partitions(self):
        files = {p: size for p, size in self._files().items() if self.only is None or p in self.only}
        step = self.stretch if self.samples else 1 << 62
        cut = [(p, lo, min(lo + step, max(size, 1))) for p, size in files.items() for lo in range(0, max(size, 1), step)]
        costs = [OPENING + (hi - lo if self.samples else HEAD) for _, lo, hi in cut]
        # A partition for each of the tasks that can run at once, more of them where these would hold more than a stretch.
        room = min(self.stretch, max(OPENING, sum(costs) // self.tasks))
        found, held = [], 0
        for (p, lo, hi), cost in zip(cut, costs, strict=True):
            folder, leaf = p[: p.rfind("/") + 1], p[p.rfind("/") + 1 :]
            if not found or held + cost > room:
                found.append(Stretches(folder, []))
                held = 0
            found[-1].parts.append((leaf, lo, hi))
            held += cost
        return found or [Stretches("", [])]

    def read(self, part):
        """Batches of rows, so that a task holds those alone whatever its partition has."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)

        def batch(rows):
            return pa.record_batch([pa.array([row[f.name] for row in rows], f.type) for f in schema], schema=schema)

        rows, samples = [], 0
        for row in self._rows(part):
            rows.append(row)
            samples += len(row.get("x", ()))
            if samples >= SAMPLES_AT_ONCE or len(rows) >= ROWS_AT_ONCE:
                yield batch(rows)
                rows, samples = [], 0
        if rows:
            yield batch(rows)

    def _rows(self, part):
        if not part.parts:
            return
        store, first = opened(part.path)
        for leaf, start, stop in part.parts:
            with store.open_input_file(first[: first.rfind("/") + 1] + leaf) as file:
                head = Header(file)
                rate = self.rate or head.rate
                n = head.n if rate == head.rate else int(round(head.n * rate / head.rate))
                known = {"path": part.folder + leaf, "name": stem(leaf), "sr": rate, "channels": head.channels, "n": n}
                if not self.samples:
                    yield known
                    continue
                for block in range(max(1, -(-n // self.block))):
                    lo, hi = block * self.block, min(n, (block + 1) * self.block)
                    # A block belongs to the stretch that holds its place in the file, in parts of the whole.
                    at = int(lo / max(n, 1) * part_size(file))
                    if not start <= at < stop:
                        continue
                    for ch, x in enumerate(self._block(file, head, rate, lo, hi)):
                        yield known | {"ch": ch, "block": block, "i0": lo, "x": x.astype(np.float32)}

    def _block(self, file, head: Header, rate: int, lo: int, hi: int) -> np.ndarray:
        if rate == head.rate:
            x = head.samples(file, lo, hi).T
        else:
            x = resample_range(lambda a, b: head.samples(file, a, b).T.astype(float), head.n, lo, hi, head.rate, rate)
        return x if self.channels in (None, head.channels) else np.repeat(x.mean(0, keepdims=True), self.channels, 0)


def part_size(file) -> int:
    return max(file.size(), 1)


@dataclass
class Written(WriterCommitMessage):
    """The names of the stems that a task wrote, and what its unfinished files end in."""

    mark: str
    names: set


class WavWriter(DataSourceWriter):
    """Rows (name, sr, n, ch, block, x) of whole stems, ordered by name, block and channel; files are written block by block."""

    def __init__(self, options: dict, schema):
        self.folder, self.bits, self.names = options["path"], int(options.get("bits", 24)), [f.name for f in schema]
        self.job = uuid.uuid4().hex
        if missing := {"name", "sr", "channels", "n", "ch", "block", "x"} - set(self.names):
            raise ValueError(f"columns missing for WAV files: {sorted(missing)}")

    def write(self, rows):
        store, root = opened(self.folder)
        store.create_dir(root, recursive=True)
        done, out, now = Written(f"{self.job}-{uuid.uuid4().hex}", set()), None, None
        try:
            held = []
            for row in rows:
                if row["name"] != now:
                    self._close(out, held)
                    now, held = row["name"], []
                    done.names.add(now)
                    out = store.open_output_stream(self._unfinished(root, now, done.mark))
                    out.write(encode_samples(np.zeros((0, row["channels"])), row["sr"], self.bits, row["n"]))
                if held and held[-1][0] != row["block"]:
                    out.write(self._frames(held))
                    held = []
                held.append((row["block"], row["ch"], row["channels"], row["x"]))
            self._close(out, held)
        except BaseException:
            self._delete(store, [self._unfinished(root, name, done.mark) for name in done.names])
            raise
        return done

    @staticmethod
    def _unfinished(root, name, mark) -> str:
        return f"{root}/.{name}.wav.{mark}"

    def _frames(self, held) -> bytes:
        if [h[1] for h in held] != list(range(held[0][2])):
            raise ValueError("every channel of a block is needed once, in order")
        return encode_samples(np.stack([np.asarray(h[3], np.float32) for h in held], 1), 0, self.bits, None)

    def _close(self, out, held):
        if out is not None:
            if held:
                out.write(self._frames(held))
            out.close()

    @staticmethod
    def _delete(store, places):
        from pyarrow import fs

        for place in places:
            if store.get_file_info(place).type == fs.FileType.File:
                store.delete_file(place)

    def commit(self, messages):
        store, root = opened(self.folder)
        for message in messages:
            for name in message.names if message else []:
                store.move(self._unfinished(root, name, message.mark), f"{root}/{name}.wav")

    def abort(self, messages):
        """Also what tasks left that ended without a message: every file of this job that has no name yet."""
        from pyarrow import fs

        store, root = opened(self.folder)
        if store.get_file_info(root).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(root)):
                if self.job in f.base_name:
                    store.delete_file(f.path)


class WavSource(DataSource):
    """Options: ``block`` and ``stretch`` (samples of a block, bytes of a partition), ``tasks`` (how many can run at once), ``rate`` and ``channels`` to convert to, ``bits`` to write."""

    @classmethod
    def name(cls):
        return "wav_blocks"

    def schema(self):
        return f"{HEADER}, {SAMPLES}"

    def reader(self, schema):
        return WavReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WavWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, sr, channels, n) of the WAV files right in a folder; a few hundred bytes of each are read."""
    register(spark)
    return spark.read.format("wav_blocks").schema(HEADER).option("tasks", spark.sparkContext.defaultParallelism).load(folder)


def read_blocks(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(path, name, sr, channels, n, ch, block, i0, x) of the WAV files right in a folder, a task for each stretch of a long file or for many short ones."""
    register(spark)
    return spark.read.format("wav_blocks").options(**{"tasks": spark.sparkContext.defaultParallelism, **options}).load(folder)


def write_stems(blocks: DataFrame, folder: str, bits: int = 24) -> None:
    """A WAV file for each stem of blocks (name, sr, channels, n, ch, block, x), all or none of them.

    Blocks of a stem meet in one task, which holds one block at a time.
    """
    register(blocks.sparkSession)
    rows = blocks.select("name", "sr", "channels", "n", "ch", "block", "x").repartition("name").sortWithinPartitions("name", "block", "ch")
    rows.write.format("wav_blocks").mode("append").option("bits", bits).save(folder)
