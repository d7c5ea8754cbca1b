"""Alignment of two tokenizers over a corpus, by distinct segments.

A text is split before a space that follows another character than white space, where neither vocabulary has a token
that goes on from such a character into a space, which is verified: no merge can cross there, so segments are encoded by themselves.
Documents become rows of numbers into the distinct segments of their block; the blocks' segments are dealt by hash, each
distinct one is tokenised and aligned once, and its alignment is joined back to the blocks that hold it. From there on
documents are composed by adding up and stringing together, block by block.

An alignment is the list of links of a segment in order. The ends of the tokens of both sides cut the bytes into stretches, and
each stretch lies in one token of either side: it is their link. A link is kept as one long, the ids of both and three marks:
whether it begins a token of A, a token of B, a group.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import ship_package, stored, table

#: UTF-8 bytes of the texts of one block, at least one text.
BLOCK_BYTES = 16 << 20
#: Bytes of text a place that distinct segments are dealt to; there are as many places as the corpus needs.
SHARD_BYTES = 8 << 20
#: Characters that are encoded by one call.
CALL_CHARS = 1 << 16
NEW_A, NEW_B, NEW_GROUP = 1, 2, 4
#: White space before a space, or at the end: texts without it are split at every space.
IRREGULAR = re.compile(r"\s(?: |$)")
SPLIT = re.compile(r"(?<=\S) (?=\s*\S)")
SPACE = "▁"


def segments(text: str) -> list[str]:
    """The segments of a space and ``text``, each without the space that it begins with."""
    return SPLIT.split(text) if text[:1].isspace() or IRREGULAR.search(text) else text.split(" ")


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        path = public_tokenizers.path(byte_level)
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order.
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        added = {t["id"]: t["content"].encode() for t in json.load(open(path, encoding="utf-8"))["added_tokens"]}
        self.a_bytes = [added.get(i, b"") for i in range(max([*vocabulary.values(), *added]) + 1)]
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(byte.__getitem__, token)) if i not in added else added[i]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        crossing = re.compile(r"\S ")
        ordinary = [t for i, t in enumerate(self.b_bytes) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        #: Whether no token of either side goes on from another character into a space.
        self.splits = not any(crossing.search(t.decode("utf-8", "replace")) for t in (*(self.a_bytes[i] for i in vocabulary.values()), *ordinary))
        self.a_size = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)

    def split(self, text: str) -> list[str]:
        return segments(text) if self.splits else [text]

    def _encode(self, text: str) -> tuple[list[int], list[int], bool]:
        """Ids of both sides of a space and ``text``, and whether both give its bytes back."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text) if text else []
        data = (" " + text).encode()
        return a, b, b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data

    def _links(self, a: list[int], b: list[int], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of a stretch of text, and how many of them each segment has, whose last bytes are given."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        cuts = np.union1d(a_end, b_end)
        at_a, at_b = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        new_a, new_b = np.diff(at_a, prepend=-1) > 0, np.diff(at_b, prepend=-1) > 0
        links = a[at_a] << 35 | b[at_b] << 3 | new_a * NEW_A | new_b * NEW_B | (new_a & new_b) * NEW_GROUP
        return links, np.diff(np.searchsorted(cuts, ends, "right"), prepend=0)

    def align(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The links of all segments one after the other, and the number of each segment's; 0 if a side doesn't give its bytes back.

        Segments go to the tokenizers strung together; those that end in white space or hold the piece model's
        mark for a space are taken one by one, and so are all of a call that doesn't give its bytes back.
        """
        links, counts = [None] * len(found), np.zeros(len(found), np.int64)

        def single(i):
            a, b, good = self._encode(found[i])
            if good:
                links[i], counts[i : i + 1] = self._links(a, b, np.array([len(found[i].encode()) + 1]))

        together: list[int] = []

        def call():
            a, b, good = self._encode(" ".join(found[i] for i in together))
            if good:
                out, n = self._links(a, b, np.cumsum([len(found[i].encode()) + 1 for i in together]))
                counts[together] = n
                for i, part in zip(together, np.split(out, np.cumsum(n)[:-1]), strict=True):
                    links[i] = part
            else:
                for i in together:
                    single(i)
            together.clear()

        size = 0
        for i, s in enumerate(found):
            if not self.splits or not s or s[-1].isspace() or SPACE in s:
                single(i)
                continue
            together.append(i)
            size += len(s)
            if size >= CALL_CHARS:
                call()
                size = 0
        if together:
            call()
        kept = [x for x in links if x is not None]
        return np.concatenate(kept) if kept else np.zeros(0, np.int64), counts


@lru_cache(maxsize=2)
def load(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


def ragged(flat: np.ndarray, counts: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked runs of ``flat`` one after the other, and their lengths."""
    starts, n = np.cumsum(counts) - counts, counts[pick]
    return flat[np.repeat(starts[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on as bytes of seven bits, the lowest first; all but the last of a number have the eighth bit set."""
    v = np.asarray(values, np.int64)
    n = 1 + sum((v >> (7 * k) > 0).astype(np.int64) for k in range(1, 9))
    starts, out = np.cumsum(n) - n, np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        here = n > k
        out[starts[here] + k] = (v[here] >> (7 * k) & 127) | np.where(n[here] > k + 1, 128, 0)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(b):
        return b
    starts = np.concatenate(([0], np.flatnonzero(b < 128)[:-1] + 1))
    n = np.diff(np.append(starts, len(b)))
    return np.add.reduceat((b & 127) << 7 * (np.arange(len(b)) - np.repeat(starts, n)), starts)


def squeezed(*columns: np.ndarray | bytes) -> bytes:
    """Arrays of 64-bit numbers (first all their lowest bytes, then the next ones) and bytes, compressed."""
    raw = [c if isinstance(c, bytes) else np.ascontiguousarray(np.asarray(c, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(columns), *map(len, raw)], "<i8").tobytes() + b"".join(raw))


def loosened(data: bytes, *kinds: type) -> list:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds), 8), 8 * (len(kinds) + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        part = raw[at : at + size]
        out.append(part if kind is bytes else np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(8, -1).T).view("<i8").ravel())
        at += size
    return out


BLOCKS = "block long, doc_id long, seq binary, shard int, segs binary"
BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.binary()), ("shard", pa.int32()), ("segs", pa.binary())])


def blocks_of(docs: DataFrame, shards: int, byte_level: str, pieces: str) -> DataFrame:
    """Rows of documents (block, doc_id, seq: packed numbers of segments) and of the segments of a block by shard.

    The latter have the segments' numbers, lengths and bytes in ``segs``. A block is a stretch of neighbouring documents. A null or
    empty text has an empty seq.
    """
    ship_package(docs.sparkSession)

    def rows(**columns):
        n = len(columns["block"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in BLOCKS_ARROW], schema=BLOCKS_ARROW)

    def run(batches):
        from pyspark import TaskContext

        split, block, numbers, size = load(byte_level, pieces).split, TaskContext.get().partitionId() << 32, {}, 0

        def close():
            names = [s.encode() for s in numbers]
            numbers.clear()
            shard = np.fromiter((zlib.crc32(s) % shards for s in names), np.int64, len(names))
            order = np.argsort(shard, kind="stable")
            places, firsts = np.unique(shard[order], return_index=True)
            cells = []
            for at in np.split(order, firsts[1:]):
                found = [names[i] for i in at]
                cells.append(squeezed(np.diff(at, prepend=0), np.array([*map(len, found)], np.int64), b"".join(found)))
            return rows(block=[block] * len(places), shard=places, segs=cells[: len(places)])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            seqs, first = [], 0
            for i, text in enumerate(texts):
                text = text.as_py() or ""
                bytes_ = len(text.encode())
                if size and size + bytes_ > BLOCK_BYTES:
                    if seqs:
                        yield rows(block=[block] * len(seqs), doc_id=ids.slice(first, len(seqs)), seq=seqs)
                    yield close()
                    block, size, seqs, first = block + 1, 0, [], i
                size += bytes_
                seqs.append(packed([numbers.setdefault(s, len(numbers)) for s in split(text)]) if text else b"")
            if seqs:
                yield rows(block=[block] * len(seqs), doc_id=ids.slice(first, len(seqs)), seq=seqs)
        if numbers:
            yield close()

    return docs.mapInArrow(run, BLOCKS)


def align_segments(dictionary: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(block, links): numbers, counts and links of each block's segments; every distinct segment of a shard is aligned once."""

    def run(shard: pa.Table) -> pa.Table:
        numbers, codes, known = [], [], {}
        for cell in shard.column("segs"):
            at, sizes, data = loosened(cell.as_py(), np.ndarray, np.ndarray, bytes)
            numbers.append(at)  # as differences
            ends = np.cumsum(sizes).tolist()
            codes.append(np.array([known.setdefault(data[a:b], len(known)) for a, b in zip([0, *ends], ends)], np.int64))
        flat, counts = load(byte_level, pieces).align([s.decode() for s in known])
        cells = [squeezed(at, *reversed(ragged(flat, counts, code))) for at, code in zip(numbers, codes, strict=True)]
        return pa.table({"block": shard.column("block"), "links": pa.array(cells, pa.binary())})

    return dictionary.select("shard", "block", "segs").groupBy("shard").applyInArrow(run, "block long, links binary")


COMPOSED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs array<long>, held array<int>"


def group_text(links: list[int]) -> str:
    """The groups of one segment: ids of A, a bar, ids of B; groups are parted by semicolons."""
    done, a, b = [], [], []
    for link in links:
        if link & NEW_GROUP and a:
            done.append(f"{','.join(a)}|{','.join(b)}")
            a, b = [], []
        if link & NEW_A:
            a.append(str(link >> 35))
        if link & NEW_B:
            b.append(str(link >> 3 & 0xFFFFFFFF))
    done.append(f"{','.join(a)}|{','.join(b)}")
    return ";".join(done)


def compose(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents, each with its sums and its linked pairs as places in the block's list; the last row has that list.

    ``held`` says how many documents of the block hold each pair linked.
    """
    cells = [loosened(c.as_py(), np.ndarray, np.ndarray, np.ndarray) for c in right.column("links")]
    none = np.zeros(0, np.int64)
    at = np.concatenate([none, *(np.cumsum(c[0]) for c in cells)])
    n, flat = (np.concatenate([none, *(c[k] for c in cells)]) for k in (1, 2))
    del cells
    flat, n = ragged(flat, n, np.argsort(at))  # by number
    pairs, place = np.unique(flat >> 3, return_inverse=True)
    place = place.astype(np.int32)
    ends = np.cumsum(n)
    starts = ends - n
    sums = np.stack([np.add.reduceat(np.append(flat & m > 0, False).astype(np.int64), starts) if len(n) else n for m in (NEW_A, NEW_B, NEW_GROUP)] + [n])
    texts = [group_text(flat[a:b].tolist()) if b > a else None for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    held = np.zeros(len(pairs), np.int32)
    out, digests, found, times = [], [], [], []
    for cell in left.column("seq"):
        seq = unpacked(cell.as_py())
        if not len(seq) or not n[seq].all():
            out.append(np.zeros(4, np.int64))
            digests.append("")
            found.append(b"")
            times.append(b"")
            continue
        out.append(sums[:, seq].sum(1))
        digests.append(hashlib.sha256(";".join(map(texts.__getitem__, seq.tolist())).encode()).hexdigest())
        k = n[seq]
        here, count = np.unique(place[np.repeat(starts[seq] - (np.cumsum(k) - k), k) + np.arange(k.sum())], return_counts=True)
        held[here] += 1
        found.append(packed(np.diff(here, prepend=0)))
        times.append(packed(count))
    docs = len(out)
    block = left.column("block")[0].as_py() if docs else right.column("block")[0].as_py()
    table = np.array(out, np.int64).reshape(docs, 4)
    rows = pa.table({
        "block": pa.array(np.full(docs, block)), "doc_id": left.column("doc_id"), **{c: pa.array(table[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        "groups_sha256": pa.array(digests, pa.string()), "places": pa.array(found, pa.binary()), "times": pa.array(times, pa.binary()),
        "pairs": pa.nulls(docs, pa.list_(pa.int64())), "held": pa.nulls(docs, pa.list_(pa.int32())),
    })
    last = {"block": pa.array([block]), "pairs": pa.array([pairs], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.int32()))}
    return pa.concat_tables([rows, pa.table({f.name: last.get(f.name, pa.nulls(1, f.type)) for f in rows.schema})])


def score(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block with the sums over their links, whose counts by place stand on the right."""
    place = right.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for places, times in zip(left.column("places"), left.column("times"), strict=True):
        at, k = np.cumsum(unpacked(places.as_py())), unpacked(times.as_py())
        n_best.append(int(best[at] @ k))
        count_sum.append(int(count[at] @ k))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    both = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table({**{c: left.column(c) for c in names}, **both, "groups_sha256": left.column("groups_sha256")})


def align_tokenizers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> tuple[DataFrame, DataFrame]:
    """What each document's tokens have to do with each other, and the corpus-wide counts (pair, a, b, count, best).

    Documents come out as often as they come in, whatever their ids, with doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256. A null or empty text, and one that a side doesn't give back, has zeros and an empty digest and
    counts for no pair. ``count`` is the number of documents that hold a pair linked, ``best`` whether no other pair of the
    same A id has more. Other columns are ignored; an empty table gives empty results.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = stored(blocks_of(texts, 1 + size // SHARD_BYTES, byte_level, pieces), "segments")
    aligned = align_segments(rows.where("shard is not null"), byte_level, pieces)
    block = rows.where("shard is null").select("block", "doc_id", "seq").groupBy("block")
    composed = stored(block.cogroup(aligned.groupBy("block")).applyInArrow(compose, COMPOSED), "composed")
    lists = composed.where("pairs is not null")
    counts = lists.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("count"))
    counts = counts.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))})
    counts = stored(counts, "pair-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    counts = counts.join(top, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    known = lists.select("block", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    told = composed.where("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times").groupBy("block")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return told.cogroup(known.groupBy("of")).applyInArrow(score, out), counts


def op13_align(spark, sf_dir):
    return align_tokenizers(table(spark, sf_dir, "documents"))[0]
