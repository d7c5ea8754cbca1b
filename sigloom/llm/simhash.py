"""Near-duplicate detection by SimHash fingerprints.

The fingerprints' segments are mapped to their bit counts. The Manhattan distance of two such vectors is at most
the Hamming distance of the fingerprints, so a grid join of the vectors finds every pair worth a look; the exact
step then keeps only true links. No step lists the pairs of a group: both join sides meet in shared grid points
(radius 1 around each, so that points within 2 share one), and a point links its members to its smallest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import cut, map_columns, neutral
from sigloom.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
SEGMENT_BITS = 2
#: Linked fingerprints differ in at most so many bits; the join meets half-way, so it is fixed at twice radius 1.
MAX_BITS = 2


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a whole text; 0 for null and for texts without a word."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(found) - words + 1
    h = [digest(line[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(np.array(h[at : at + 65536], ">u8").view(np.uint8))
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def add_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), out: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint of each row as a signed long."""

    def make():
        def run(texts):
            f = [fingerprint(t) for t in texts]
            return [[x - (1 << 64) if x >> 63 else x for x in f]]

        return run

    return map_columns(docs, [text], make, pa.schema([(out, pa.int64())]), f"`{out}` long", keep)


def segment_counts(fp: F.Column, bits: int = SEGMENT_BITS) -> F.Column:
    """The bit count of each segment, packed into one long: ``bits`` bits hold each count."""
    packed = F.lit(0).cast("long")
    for at in range(0, 64, bits):
        count = F.bit_count(fp.bitwiseAND(F.lit(((1 << bits) - 1) << at if at + bits < 64 else -1 << at)))
        packed = packed.bitwiseOR(F.shiftleft(count.cast("long"), at))
    return packed


def near_points(vector: F.Column, bits: int = SEGMENT_BITS) -> F.Column:
    """The grid points within Manhattan distance 1 of a packed vector. Steps that leave 0..bits are left out."""
    steps = []
    for at in range(0, 64, bits):
        count = F.shiftrightunsigned(vector, at).bitwiseAND(F.lit((1 << bits) - 1))
        steps.append(F.when(count < bits, vector.bitwiseXOR(bump(count, at, 1))))
        steps.append(F.when(count > 0, vector.bitwiseXOR(bump(count, at, -1))))
    return F.array_compact(F.array(vector, *steps))


def bump(count: F.Column, at: int, by: int) -> F.Column:
    """What to xor into the packed vector so that the count at a place changes by one; free of overflow."""
    return F.shiftleft(count.bitwiseXOR(count + F.lit(by)).cast("long"), at)


def fingerprint_links(fps: DataFrame, fp: str = "fp", counts: str = "counts") -> DataFrame:
    """(a, b): links between distinct fingerprints, given with their packed segment counts, whose components are those of all pairs within MAX_BITS bits.

    1. Grid join: fingerprints whose count vectors lie within Manhattan distance 2 share a grid point within 1 of
       each. A point met by one fingerprint only is dropped; so are fingerprints with no point left.
    2. Exact step for those: two fingerprints differ in at most 2 bits if and only if some 64-bit value differs in
       at most 1 bit from both. Each such value links its members to the smallest of them, itself a true link.
    """
    one = fps.select(F.col(fp).alias("f"), F.col(counts).alias("c"))
    spread = one.select("f", F.explode(near_points(F.col("c"))).alias("p"))
    shared = spread.groupBy("p").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo <> hi").select("p")
    close = cut(spread.join(shared, "p", "left_semi").select("f").distinct())
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -1 << 63) for k in range(64)))
    ball = close.select("f", F.explode(flips).alias("x")).select("f", F.col("f").bitwiseXOR(F.col("x")).alias("w"))
    low = ball.groupBy("w").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo <> hi").select("w", "lo")
    return ball.join(low, "w").where("f <> lo").select(F.col("f").alias("a"), F.col("lo").alias("b")).distinct()


def print_components(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint in (doc_id, fp): one root per component, and its smallest doc_id."""
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("counts", segment_counts(F.col("fp"))))
    comp = connected_components(fingerprint_links(firsts))
    named = firsts.join(comp, firsts.fp == comp.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(lows, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long) and component_id (smallest doc_id reachable) of every row.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows that repeat a doc_id come out as
    often as they came in. Null ids get a component, but never name one unless all its ids are null. Extra columns
    are ignored; an empty table gives an empty result.
    """
    prints = cut(add_fingerprints(docs, text, [doc_id]).select(F.col(doc_id).alias("doc_id"), "fp"))
    ids = cut(print_components(prints).select("fp", "component_id"))
    # Both sides are read from checkpoints and dealt by the join itself, so that a large group of copies is split at run time.
    return prints.join(ids, "fp", "left").select("doc_id", "fp", "component_id")


def hex_of(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``docs``, with the smallest id in it; rows with a null id all stay.

    An id may stand for several texts: each row counts with the component of its own text. Of rows of a component that
    repeat its smallest id one stays, by the hash of the text, then of the row. Components are those of op1, links of
    fingerprints within MAX_BITS bits. Extra columns may have any names.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("x"))
    prints = cut(add_fingerprints(keyed, "x", ["doc_id", "t"]))
    roots = cut(print_components(prints).select("fp", "root"))
    each = prints.where("doc_id is not null").join(roots, "fp").groupBy("root", "doc_id", "t").agg(F.count("*").alias("n"))
    each = cut(each.select("root", F.struct("doc_id", "t").alias("o"), "n"))
    best = cut(each.groupBy("root").agg(F.min("o").alias("best")))
    marks = each.join(best, "root").select(F.col("o.doc_id").alias("__d"), F.col("o.t").alias("__t"), (F.col("o") != F.col("best")).alias("__gone"), "n")
    marks = cut(marks.where(F.col("__gone") | (F.col("n") > 1)).drop("n"))
    plain, name, back = neutral(docs)
    same = (F.col(name[doc_id]) == F.col("__d")) & (F.xxhash64(name[text]) == F.col("__t"))
    rest = plain.join(marks.where("__gone"), same, "left_anti")
    repeats = marks.where("not __gone")
    if repeats.isEmpty():
        return back(rest)
    row = F.struct(*plain.columns)
    hashed = F.xxhash64(*(f.name for f in plain.schema if "map" not in f.dataType.simpleString()))
    one = rest.join(repeats, same).groupBy("__d", "__t").agg(F.min_by(row, hashed).alias("row")).select("row.*")
    return back(rest.join(repeats, same, "left_anti").unionAll(one))


def op1_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
