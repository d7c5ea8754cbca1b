"""TIFF pages: walks image directories, decodes strips and tiles, and emits one row per page.

Reads both byte orders; uncompressed, PackBits, LZW and deflate data; strips and tiles; horizontal differencing;
8- and 16-bit samples in chunky or separate planes, and 1-, 2- and 4-bit ones, which come out as a byte each. Also writes 8-bit grey or colour pages for storing payloads.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import map_columns, ship_package, table

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FILL_ORDER = 266
TYPE_SIZES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 5: (8, ""), 10: (8, ""), 7: (1, "B"), 11: (4, "f"), 12: (8, "d")}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END = 256, 257


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes
    problem: str | None = None


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more become two bytes; other bytes are copied in stretches of up to 128."""
    out, at = bytearray(), 0

    def literal(stop: int) -> None:
        for i in range(at, stop, 128):
            part = data[i : min(stop, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literal(m.start())
        out.extend((257 - len(m[0]), m[0][0]))
        at = m.end()
    literal(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


#: Codes that follow a clear code before the table is full, and the bits of each, as the format widens them one code early.
LZW_CODES = 3840
LZW_BITS = 9 + np.searchsorted((254, 766, 1790), np.arange(LZW_CODES + 1), "right")
LZW_STARTS = np.concatenate(([0], np.cumsum(LZW_BITS)))


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, that widen one code early, as the format asks; a clear code when the table is full."""
    codes, table, free = [LZW_CLEAR], {}, 258
    add, get = codes.append, table.get
    word = data[0] if data else -1
    for byte in data[1:]:
        key = word << 8 | byte
        longer = get(key)
        if longer is not None:
            word = longer
            continue
        add(word)
        table[key] = free
        free += 1
        if free == 4094:
            add(LZW_CLEAR)
            table.clear()
            free = 258
        word = byte
    if word >= 0:
        add(word)
    add(LZW_END)
    held = np.array(codes, ">u2")
    clears = np.flatnonzero(held == LZW_CLEAR)
    since = np.arange(len(held)) - clears[np.searchsorted(clears, np.arange(len(held)), "left") - 1] - 1
    bits = np.where(np.arange(len(held)) == 0, 9, LZW_BITS[np.clip(since, 0, LZW_CODES)])
    spread = np.unpackbits(held.view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(spread[np.arange(16) >= 16 - bits[:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes are cut out a table's life at a time, by their known widths, and looked up one by one."""
    padded = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    out, total, bit = [], 0, 0
    while bit + 9 <= 8 * len(data) and total < size:
        # The first code may be a clear code, which takes part in no entry; so may any later one, which ends the stretch.
        starts = bit + LZW_STARTS[:-1]
        starts = starts[starts + LZW_BITS <= 8 * len(data)]
        at = starts >> 3
        window = padded[at] << 16 | padded[at + 1] << 8 | padded[at + 2]
        codes = window >> (24 - (starts & 7) - LZW_BITS[: len(starts)]).astype(np.uint32) & ((1 << LZW_BITS[: len(starts)]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == LZW_CLEAR) | (codes == LZW_END))
        count = int(stops[0]) if len(stops) else len(codes)
        table, last = list(start), b""
        grow = table.append
        for code in codes[:count].tolist():
            if last:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise ValueError("LZW code out of order")
                grow(last + entry[:1])
                last = entry
            elif code < 256:
                last = table[code]
            else:
                raise ValueError("LZW code out of order")
            out.append(last)
            total += len(last)
            if total >= size:
                break
        if count == len(codes) or int(codes[count]) == LZW_END:
            break
        bit = int(starts[count] + LZW_BITS[count])
    return b"".join(out)[:size]


def expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {compression}")


def squeeze(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, 6), LZW: lzw_encode, PACKBITS: pack_bits}[compression](data)


#: A tile may have more bytes of pixels than four times its page only up to so many.
TILE_BYTES = 1 << 24


def read_pages(data: bytes, max_bytes: int = 1 << 30) -> list[Page]:
    return list(walk_pages(data, max_bytes))


def walk_pages(data: bytes, max_bytes: int = 1 << 30) -> Iterator[Page]:
    """Every page that the chain of directories leads to, one at a time.

    A page that can't be decoded whole, has more than ``max_bytes`` bytes of pixels or tiles out of all proportion (over TILE_BYTES and
    four times the page) carries a problem and no pixels.
    """
    if data[:4] in (b"II+\0", b"MM\0+"):
        yield Page(0, 0, 0, 0, 0, 0, 0, False, b"", "BigTIFF")
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        return
    order = "<" if data[:2] == b"II" else ">"
    number, seen = 0, set()
    (at,) = struct.unpack_from(order + "I", data, 4)
    while at and at not in seen and at + 2 <= len(data):
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, list] = {}
        try:
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                size, code = TYPE_SIZES.get(kind, (0, ""))
                where = at + 10 + 12 * k
                if size * count > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                if code and code != "s" and where + size * count <= len(data):
                    tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, where))
            page = _page(data, tags, number, order, max_bytes)
        except (struct.error, ValueError, KeyError, zlib.error, IndexError, OverflowError) as why:
            page = Page(number, 0, 0, 0, 0, 0, 0, False, b"", f"{type(why).__name__}: {why}")
        yield page
        number += 1
        if at + 6 + 12 * n > len(data):
            return
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


#: Each byte with its bits in the opposite order, as fill order 2 has them.
MIRRORED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def widen(data: bytes, rows: int, columns: int, bits: int) -> bytes:
    """A byte for each sample of fewer bits, the high bits of a byte first; each row starts at a byte."""
    held = np.frombuffer(data, np.uint8, rows * -(-columns * bits // 8)).reshape(rows, -1)
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    return (held[:, :, None] >> shifts & ((1 << bits) - 1)).reshape(rows, -1)[:, :columns].astype(np.uint8).tobytes()


def _page(data: bytes, tags: dict[int, list], number: int, order: str, max_bytes: int) -> Page:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples, bits = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if not all(isinstance(x, int) and x > 0 for x in (width, height, samples, planar)):
        raise ValueError("a size that is no positive number")
    if bits not in (1, 2, 4, 8, 16):
        raise ValueError(f"{bits} bits a sample")
    if bits < 8 and predictor != 1:
        raise ValueError(f"predictor {predictor} of {bits} bits a sample")
    if width * height * samples * max(bits, 8) // 8 > max_bytes:
        raise ValueError("page too large")
    tiled = TILE_OFFSETS in tags
    w, h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    offsets, counts = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    if not all(isinstance(x, int) and x > 0 for x in (w, h)) or not all(isinstance(x, int) for x in [*offsets, *counts]):
        raise ValueError("a strip or tile of no size")
    across, down, depth = math.ceil(width / w), math.ceil(height / h), samples if planar == 1 else 1
    if w * h * depth * max(bits, 8) // 8 > max(TILE_BYTES, 4 * width * height * samples * max(bits, 8) // 8):
        raise ValueError("tile too large for its page")
    if not len(offsets) == len(counts) == across * down * (1 if planar == 1 else samples):
        raise ValueError(f"{len(offsets)} strips or tiles of {across * down * (1 if planar == 1 else samples)}")
    kind = np.dtype("u1") if bits <= 8 else np.dtype(f"{order}u2")
    image = np.zeros((height, width, samples), kind.newbyteorder("=") if bits == 16 else kind)
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, place = divmod(k, across * down)
        y, x = place // across * h, place % across * w
        rows = h if tiled else min(h, height - y)
        packed = data[offset : offset + count]
        if bits < 8:
            packed = packed.translate(MIRRORED) if one(FILL_ORDER, 1) == 2 else packed
            raw = widen(expand(packed, compression, rows * -(-w * depth * bits // 8)), rows, w * depth, bits)
        else:
            raw = expand(packed, compression, rows * w * depth * kind.itemsize)
        part = np.frombuffer(raw, kind, rows * w * depth).reshape(rows, w, depth).astype(image.dtype)
        if predictor == 2:
            part = np.cumsum(part, 1, dtype=image.dtype)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor}")
        part = part[: height - y, : width - x]
        where = slice(None) if planar == 1 else slice(plane, plane + 1)
        image[y : y + part.shape[0], x : x + part.shape[1], where] = part
    return Page(number, width, height, samples, bits, compression, predictor, tiled, image.tobytes())


def write_pages(pages: list[tuple[np.ndarray, int, int, tuple[int, int] | None]], rows_per_strip: int = 64) -> bytes:
    """A little-endian file of 8-bit pages: (height x width x samples array, compression, predictor, tile size or None)."""
    out = bytearray(b"II*\0" + struct.pack("<I", 0))
    link = 4
    for image, compression, predictor, tile in pages:
        height, width, samples = image.shape
        w, h = tile or (width, rows_per_strip)
        offsets, counts = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = image[y : y + h, x : x + w]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate((part[:, :1], part[:, 1:] - part[:, :-1]), 1)
                packed = squeeze(np.ascontiguousarray(part).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tile:
            entries += [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            entries += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [h]), (STRIP_COUNTS, 4, counts)]
        fields = bytearray()
        for tag, kind, values in sorted(entries):
            packed = struct.pack(f"<{len(values)}{TYPE_SIZES[kind][1]}", *values)
            if len(packed) > 4:
                place = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack("<I", place)
            fields += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + fields
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


#: Bytes of a page of a stored payload at most; a multiple of a row.
PAGE_BYTES = 192 * 4096
ROW = 192

#: Compression, predictor and tile size of stored pages.
FORMS = (
    (LZW, 1, None), (LZW, 2, (32, 32)), (PACKBITS, 1, None), (PACKBITS, 2, (64, 64)),
    (DEFLATE, 1, (64, 64)), (DEFLATE, 2, None), (DEFLATE, 2, (32, 16)), (NONE, 1, None),
)


def store(payload: bytes) -> bytes:
    """The payload as colour pages of 64 pixels a row. Its own checksum picks the form of its pages."""
    form = FORMS[zlib.crc32(payload) % len(FORMS)]
    parts = [payload[at : at + PAGE_BYTES] for at in range(0, len(payload), PAGE_BYTES)]
    return write_pages([(np.frombuffer(p, np.uint8).reshape(-1, ROW // 3, 3), *form) for p in parts])


def features(data: bytes) -> str:
    """Mean, spread and entropy of the bytes, and the mean step along a row."""
    x = np.frombuffer(data, np.uint8)
    share = np.bincount(x, minlength=256) / max(1, len(x))
    share = share[share > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    return f"mean={x.mean() if len(x) else 0:.4f};std={x.std() if len(x) else 0:.4f};entropy={-(share * np.log2(share)).sum():.4f};step={step:.4f}"


def add_media(docs: DataFrame, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """Stores each whole text as TIFF pages, reads the stored bytes back and describes what was read.

    Null counts as empty; the payload of an empty text is one row of 192 spaces. Equal texts give equal values. Rows
    that repeat come out as often as they came in; an empty table gives an empty result.
    """

    def make():
        def run(texts):
            rows = []
            for t in texts:
                data = (t or "").encode("utf-8", "replace")
                media = store(data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" "))
                pages = read_pages(media)
                bad = next((p.problem for p in pages if p.problem), None)
                if bad:
                    raise ValueError(bad)
                back = b"".join(p.pixels for p in pages)
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(back), len(pages)))
            return [list(c) for c in zip(*rows, strict=True)]

        return run

    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int64())]
    ddl = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long"
    return map_columns(docs, [text], make, pa.schema(fields), ddl, keep)


def pages_of(files: DataFrame, content: str = "content", keep: list[str] = ("path",)) -> DataFrame:
    """One row per page of binary files: ``keep`` columns (of which none may be named like a page column), page number,
    width, height, samples, bits, compression, predictor, tiled, pixels and problem.

    A null, empty or foreign file has no page; a broken or incomplete page, one over 1 GiB, or a BigTIFF file has a problem
    and no pixels.
    """
    fields = [("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("problem", pa.string())]
    if clash := {c.lower() for c in keep} & {n for n, _ in fields}:
        raise ValueError(f"columns to keep have the names of page columns: {sorted(clash)}")
    ship_package(files.sparkSession)
    picked = list(dict.fromkeys([*keep, content]))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                data = row.column(picked.index(content))[0].as_py() or b""
                for p in walk_pages(data):  # a page at a time, so that a file's pages are never all in memory
                    values = (p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, p.problem)
                    columns = [row.column(picked.index(c)) for c in keep] + [pa.array([v], t) for v, (_, t) in zip(values, fields, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(n for n, _ in fields)])

    kept = "".join(f"`{c}` {t}, " for c, t in files.select(*(F.col(f"`{c}`") for c in keep)).dtypes)
    ddl = "page int, width long, height long, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, problem string"
    return files.select(*(F.col(f"`{c}`") for c in picked)).mapInArrow(run, kept + ddl)


def op6_tiff(spark, sf_dir):
    return add_media(table(spark, sf_dir, "documents"))
