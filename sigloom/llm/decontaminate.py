"""Benchmark passages inside documents, by containment of word shingles.

Test items are partitioned by the number of their shingles. An item's sketch is its smallest shingle hashes, as many
as its partition needs for a guarantee: a document that holds a share t of an item's q shingles misses at most
(1 - t) q of them, so any floor((1 - t) q) + 1 of them hold a hit. Only sketches are looked up: a document is a candidate
for the items of which it has a sketch hash. Candidates alone meet all shingles of their items, in a join by document and
shingle, which counts them exactly. Of documents without a hit nothing is stored or shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import map_columns, neutral, stored, words_of

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Distinct sketch hashes that are broadcast, at most (8 bytes each). Of more a bit table is, of 1 << SLOT_BITS bits at most,
#: and the texts whose hashes it lets pass are looked up by a join; the documents are read twice then.
SKETCH_HASHES, SLOT_BITS = 2_000_000, 28
WORD_MEMO = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words_of(text))), np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all stretches of ``size`` word hashes, in their order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def item_shingles(words: np.ndarray) -> np.ndarray:
    """An item's distinct shingles, smallest first; one with fewer words than a shingle has is a single shorter shingle."""
    return np.unique(shingle_hashes(words, min(SHINGLE_WORDS, len(words)))) if len(words) else np.zeros(0, np.uint64)


def sketch_length(q: int, threshold: float) -> int:
    """Smallest hashes in the sketch of an item of ``q`` shingles, by the largest size in its partition (powers of two)."""
    upper = (1 << int(q).bit_length()) - 1
    return min(q, int(np.floor((1 - threshold) * upper + 1e-9)) + 1)


def item_table(items: DataFrame, item_id: str, text: str, threshold: float) -> DataFrame:
    """(item, item_id, size, q, h, sketch) of the items with a word: a number, the id, words of a shingle, all shingles and the sketch."""

    def make():
        memo = WordHashes()

        def run(texts):
            found = [memo.of(t) for t in texts]
            shingles = [item_shingles(w).view(np.int64).tolist() for w in found]
            sketches = [h[: sketch_length(len(h), threshold)] if h else [] for h in shingles]
            return [[min(SHINGLE_WORDS, len(w)) for w in found], [len(h) for h in shingles], shingles, sketches]

        return run

    schema = pa.schema([("size", pa.int32()), ("q", pa.int64()), ("h", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
    plain = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("x"))
    rows = map_columns(plain, ["x"], make, schema, "size int, q bigint, h array<bigint>, sketch array<bigint>", ["item_id"])
    return stored(rows.where("q > 0").withColumn("item", F.monotonically_increasing_id()), "items")


class Slots:
    """A set of any number of 64-bit hashes, as two bits of a table for each: what isn't in the table isn't in the set."""

    def __init__(self, words: np.ndarray, width: int):
        self.words, self.width, self.mask = words, np.uint64(width), np.uint64((1 << width) - 1)

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Slots:
        """The table of a column, 64 bits or more a row up to 1 << SLOT_BITS in all; Spark sets the bits, 64 of them a row that comes back."""
        width = min(SLOT_BITS, max(10, df.count().bit_length() + 6))
        places = [F.shiftrightunsigned(F.col(column), k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in (0, 1)]
        slots = df.select(F.explode(F.array(*places)).alias("p")).withColumn("bit", F.expr("shiftleft(1L, cast(p & 63 as int))"))
        rows = slots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(1 << (width - 6), np.uint64)
        words[rows["w"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return cls(words, width)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        low, six = np.uint64(63), np.uint64(6)
        found = np.ones(len(hashes), bool)
        for h in (hashes, hashes >> self.width):
            p = h & self.mask
            found &= (self.words[(p >> six).astype(np.int64)] >> (p & low) & np.uint64(1)).astype(bool)
        return found


class Sketches:
    """Sorted sketch hashes, and a bit table that turns most lookups away; of hashes too many to hold, the table alone."""

    def __init__(self, sizes: list[int], hashes: np.ndarray | None, slots: Slots | None = None):
        self.hashes, self.sizes, self.slots = hashes, sizes, slots
        if hashes is not None:
            width = max(20, len(hashes).bit_length() + 4)  # a sixteenth of the table is set at most
            self.shift = np.uint64(64 - width)
            self.bits = np.zeros(1 << width, bool)
            self.bits[(hashes >> self.shift).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of a document that may be, or if they are held are, of a sketch, and all its shingles with repeats."""
        every = np.concatenate([shingle_hashes(words, n) for n in self.sizes])
        if self.hashes is None:
            return np.unique(every[self.slots.has(every)]), every
        near = np.unique(every[self.bits[(every >> self.shift).astype(np.int64)]])
        return near[self.hashes[np.minimum(np.searchsorted(self.hashes, near), len(self.hashes) - 1)] == near], every


def near_texts(docs: DataFrame, sketch: DataFrame, sizes: list[int], text: str, slots: Slots) -> Slots:
    """The hashes of the texts that hold a sketch hash. Of a text only the hashes that pass the table of sketches are stored."""
    shared = docs.sparkSession.sparkContext.broadcast(Sketches(sizes, None, slots))

    def make():
        memo, sketches = WordHashes(), shared.value
        return lambda texts: [[sketches.find(memo.of(t))[0].view(np.int64).tolist() for t in texts]]

    schema = pa.schema([("hits", pa.list_(pa.int64()))])
    marked = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("mark"), text)
    passed = map_columns(marked, [text], make, schema, "hits array<bigint>", ["mark"]).where(F.size("hits") > 0)
    passed = stored(passed, "sketch-passes").select("mark", F.explode("hits").alias("s"))
    return Slots.of(stored(passed.join(sketch.select("s").distinct(), "s").select("mark").distinct(), "near-texts"), "mark")


def contained_pairs(docs: DataFrame, items: DataFrame, text: str, keys: list[str], threshold: float) -> DataFrame:
    """``keys`` columns, item, q and n_shared of each document row and item (of an item table) from the threshold on."""
    spark = docs.sparkSession
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most SHINGLE_WORDS numbers
    if not sizes:
        return docs.select(*keys, F.lit(0).cast("long").alias("item"), F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("n_shared")).limit(0)
    sketch = items.select("item", F.explode("sketch").alias("s"))
    few, texts = sketch.select("s").distinct(), None
    if few.count() <= SKETCH_HASHES:
        sketches = Sketches(sizes, np.sort(few.toArrow()["s"].to_numpy().view(np.uint64)))
    else:
        sketches = Sketches(sizes, None, Slots.of(few, "s"))
        texts = near_texts(docs, sketch, sizes, text, sketches.slots)
    shared = spark.sparkContext.broadcast((sketches, texts))

    def make():
        memo, (sketches, texts) = WordHashes(), shared.value

        def found(t):
            near, every = sketches.find(memo.of(t))
            return (near.view(np.int64).tolist(), np.unique(every).view(np.int64).tolist()) if len(near) else ([], [])

        def run(bodies, marks):
            wanted = [True] * len(marks) if texts is None else texts.has(np.array(marks, np.int64).view(np.uint64))
            pairs = [found(t) if w else ([], []) for t, w in zip(bodies, wanted, strict=True)]
            return [[hits for hits, _ in pairs], [every for _, every in pairs]]

        return run

    schema = pa.schema([("hits", pa.list_(pa.int64())), ("h", pa.list_(pa.int64()))])
    marked = docs.select(*keys, text, F.xxhash64(text).alias("__mark"))
    near = map_columns(marked, [text, "__mark"], make, schema, "hits array<bigint>, h array<bigint>", keys).where(F.size("hits") > 0)
    near = stored(near.withColumn("row", F.monotonically_increasing_id()), "near-items")
    pairs = near.select("row", F.explode("hits").alias("s")).join(sketch, "s").select("row", "item").distinct()
    wanted = pairs.join(items.select("item", F.explode("h").alias("h")), "item")
    counts = wanted.join(near.select("row", F.explode("h").alias("h")), ["row", "h"]).groupBy("row", "item").agg(F.count("*").alias("n_shared"))
    exact = counts.join(items.select("item", "q"), "item").where(F.col("n_shared") + 1e-9 >= threshold * F.col("q"))
    return near.select("row", *keys).join(exact, "row").select(*keys, "item", "q", "n_shared")


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of each pair from the threshold on.

    Null and empty texts contain and are contained in nothing. A repeated document or item makes its pairs again. Ids have
    any type, and nulls are ids. An empty table on either side gives an empty result. Extra columns are ignored.
    """
    index = item_table(items, item_id, item_text, threshold)
    plain = docs.select(F.col(f"`{doc_id}`").alias("k"), F.col(f"`{text}`").alias("x"))
    found = contained_pairs(plain, index, "x", ["k"], threshold).join(index.select("item", "item_id"), "item")
    share = (F.col("n_shared") / F.col("q")).alias("containment")
    return found.select(F.col("k").alias("doc_id"), "item_id", "n_shared", F.col("q").alias("n_item"), share)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item; null and empty texts stay. Extra columns may have any names.

    Texts that contain one are known by two 64-bit hashes, whatever their row.
    """
    plain, name, back = neutral(docs)
    marks = lambda c: [F.xxhash64(c), F.xxhash64(c, F.lit(1))]
    index = item_table(items, item_id, item_text, threshold)
    texts = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("x"))
    keyed = texts.select("x", *(m.alias(f"__{i}") for i, m in enumerate(marks(F.col("x")))))
    bad = stored(contained_pairs(keyed, index, "x", ["__0", "__1"], threshold).select("__0", "__1").distinct(), "contaminated")
    same = [m == F.col(f"__{i}") for i, m in enumerate(marks(F.col(name[text])))]
    return back(plain.join(bad, same[0] & same[1], "left_anti"))


def op9_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP9_SQL = f"""
WITH items AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
docs AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
sized AS (SELECT item_id, w, least({SHINGLE_WORDS}, len(w)) AS k FROM items WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
isz AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY 1),
dsh AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k))
SELECT d.doc_id, i.item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(any_value(n_item) AS BIGINT) AS n_item, count(*) / CAST(any_value(n_item) AS DOUBLE) AS containment
FROM dsh d JOIN ish i USING (k, s) JOIN isz USING (item_id)
GROUP BY d.doc_id, i.item_id HAVING count(*) >= {THRESHOLD} * any_value(n_item)
"""
