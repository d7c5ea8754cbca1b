"""Text quality by compression: which of two dictionaries, of good or of bad text, compresses a text better.

Three views of a text are compressed block by block: the bytes; their shape (letters, capitals and digits folded), in which the
form of a text shows whatever its language; and its recurrence, which says of each word how many words before it stood last, so that words said over
and over don't hide in what any dictionary compresses well. The normalised differences of the compressed sizes, one for each view, are all that
the calibration sees; it is fitted on other labelled documents than the dictionaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import hash_threshold, id_remainder, map_columns
from sigloom.llm.learn import fit_logistic, predict

#: Labelled documents used at most: half for dictionaries, half for calibration.
SAMPLE_DOCS = 8000
#: Bytes compressed at a time; a text is cut whole into such blocks.
BLOCK = 512
#: Bytes of a dictionary, and blocks of each class that it is built from at most, chosen by hash among all blocks of its documents.
DICTIONARY, DICTIONARY_BLOCKS = 100_000, 8000
LEVEL = 3
#: The words that recurrence looks back; bytes of its blocks (four words), and the level that they are compressed at.
BACK, NEAR_BLOCK, NEAR_LEVEL = 8, 16, 12
NEAR = (b"far ", b"one ", b"two ", b"tri ", b"qua ", b"qui ", b"hex ", b"sep ", b"oct ")
THRESHOLD = 0.3
SHAPE = bytes(
    97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if b >= 128 else b for b in range(256)
)


def build(blocks: list[bytes]) -> bytes:
    """A zstandard dictionary of the blocks; of too few for one, the blocks themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


def recurrence(data: bytes) -> bytes:
    """Four bytes a word: how many words before it the same word stood last, up to BACK, or far."""
    last: dict[bytes, int] = {}
    out, get = [], last.get
    for i, w in enumerate(data.split()):
        back = i - get(w, -BACK - 1)
        out.append(NEAR[back if back <= BACK else 0])
        last[w] = i
    return b"".join(out)


#: The views, each with the size of its blocks and the level of compression.
VIEWS = ((bytes, BLOCK, LEVEL), (lambda data: data.translate(SHAPE), BLOCK, LEVEL), (recurrence, NEAR_BLOCK, NEAR_LEVEL))


def blocks_of(data: bytes, size: int = BLOCK) -> list[bytes]:
    return [data[at : at + size] for at in range(0, len(data), size)] or [b""]


class Compressors:
    """Two compressors for each view, of good and of bad text; ``features`` gives a text's numbers."""

    def __init__(self, dictionaries: list[bytes]):
        self.parts, self.known = [], {}
        for k, data in enumerate(dictionaries):
            level = VIEWS[k // 2][2]
            known = zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None
            if known is not None:
                known.precompute_compress(level=level)
            self.parts.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False))

    def features(self, text: str | None) -> list[float]:
        """For each view: compressed size with the bad dictionary less that with the good one, by the larger of them."""
        data, out, known = (text or "").encode("utf-8", "replace"), [], self.known
        for k, (view, size, _) in enumerate(VIEWS):
            good, bad = self.parts[2 * k : 2 * k + 2]
            g = b = 0
            for x in blocks_of(view(data), size):
                pair = known.get(x) if view is recurrence else None
                if pair is None:
                    pair = len(good.compress(x)), len(bad.compress(x))
                    if view is recurrence:  # there are some thousands of them
                        known[x] = pair
                g, b = g + pair[0], b + pair[1]
            out.append((b - g) / max(g, b))
        return out


def sample_blocks(docs: DataFrame, text: str, k: int) -> list[bytes]:
    """At most DICTIONARY_BLOCKS blocks of a view of the whole texts, by the hash of document and place."""
    view, size, _ = VIEWS[k]

    def make():
        return lambda texts: [[blocks_of(view((t or "").encode("utf-8", "replace")), size) for t in texts]]

    each = map_columns(docs, [text], make, pa.schema([("b", pa.list_(pa.binary()))]), "b array<binary>", ["doc_id"])
    each = each.select("doc_id", F.posexplode("b").alias("i", "b")).where(F.length("b") > 0)
    found = each.select(F.xxhash64("doc_id", "i").alias("h"), "b").orderBy("h", "b").limit(DICTIONARY_BLOCKS).collect()
    return [bytes(r.b) for r in found]


class Scorer:
    def __init__(self, dictionaries: list[bytes], weights: np.ndarray):
        self.dictionaries, self.weights = dictionaries, weights


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", sample: int = SAMPLE_DOCS) -> Scorer:
    """Dictionaries and calibration from at most ``sample`` labelled documents, chosen by the hash of the id.

    Null labels and null texts teach nothing; a document labelled twice takes its larger label, and of a repeated id the
    least text counts. With no label of one kind, the score is the share of good labels, or a half without any label.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    limit = hash_threshold(marks, "doc_id", sample)
    if limit is None:
        return Scorer([b""] * 6, fit_logistic(np.zeros((0, 3)), np.zeros(0)))
    marks = marks.where(F.xxhash64("doc_id") <= limit)
    known = docs.where((F.xxhash64("doc_id") <= limit) & F.col(text).isNotNull()).select("doc_id", F.col(text).alias("t"))
    known = known.groupBy("doc_id").agg(F.min("t").alias("t")).join(F.broadcast(marks), "doc_id")  # at most `sample` labels
    half = F.xxhash64("doc_id", F.lit(1)) % 2 == 0
    good, bad = (known.where(half & (F.col("y") == y)) for y in (1, 0))
    dictionaries = [build(sample_blocks(rows, "t", k)) for k in range(len(VIEWS)) for rows in (good, bad)]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        parts = Compressors(shared.value)
        return lambda texts: [list(x) for x in zip(*(parts.features(t) for t in texts), strict=True)]

    names = [f"f{k}" for k in range(len(VIEWS))]
    schema = pa.schema([(n, pa.float64()) for n in names])
    rows = map_columns(known.where(~half), ["t"], make, schema, ", ".join(f"{n} double" for n in names), ["y"]).select(*names, "y").collect()
    rows.sort()
    x = np.array([r[:-1] for r in rows]).reshape(-1, len(VIEWS))
    return Scorer(dictionaries, fit_logistic(x, np.array([r.y for r in rows], float), 0.1, 1500))


def add_quality(docs: DataFrame, scorer: Scorer, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score (0 to 1, higher is better) and predicted (1 from THRESHOLD on) of every whole text.

    Null counts as empty. Rows that repeat come out as often as they came in; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def make():
        parts, weights = Compressors(shared.value.dictionaries), shared.value.weights

        def run(texts):
            score = predict(weights, np.array([parts.features(t) for t in texts]).reshape(len(texts), -1)) if texts else np.zeros(0)
            return [score.tolist(), (score >= THRESHOLD).astype(int).tolist()]

        return run

    schema = pa.schema([("score", pa.float64()), ("predicted", pa.int32())])
    return map_columns(docs, [text], make, schema, "score double, predicted int", keep)


def op7_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = fit(docs, labels.where(id_remainder("doc_id", 5) != 0))
    found = add_quality(docs, scorer)
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
