"""Toxicity by a classifier chain.

Linear models predict the categories one after the other, and each later model also sees the probabilities of the
earlier categories. In training these are out-of-fold predictions, so that a later model doesn't trust an earlier one
more than it deserves; for them the terms are chosen without the fold as well. The terms of the models are words and beginnings
of longer words, chosen by how far their document rates differ between the classes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import cut, hash_threshold, id_remainder, map_columns, neutral, words_of
from sigloom.llm.learn import fit_logistic, predict

#: Labelled documents used for training at most, chosen by the hash of the id.
SAMPLE_DOCS = 6000
#: Terms in a model at most, documents a term must be in at least, and bytes of the beginnings of words that are terms.
VOCABULARY, LEAST_DOCS, BEGINNING = 1000, 3, 5
FOLDS = 4
THRESHOLD = 0.5
CATEGORIES = ("severe", "repeated", "toxic")


def terms_of(text: str | None) -> list[bytes]:
    """The words of a text and, with a mark that no word holds, the beginnings of those longer than BEGINNING."""
    words = words_of(text)
    return words + [b"^" + w[:BEGINNING] for w in words if len(w) > BEGINNING]


class Chain:
    """Terms, and for each category in order the weights over terms, counts and earlier probabilities."""

    def __init__(self, words: list[bytes], signs: list[float], models: list[np.ndarray], categories: tuple[str, ...]):
        self.words, self.signs, self.models, self.categories = words, np.array(signs), models, categories

    def features(self, counts: Iterable[dict[int, int]], n: int) -> np.ndarray:
        """For each of n documents: presence of each term, then log numbers of marked terms, all and distinct."""
        x = np.zeros((n, len(self.words) + 2), np.float32)
        for row, count in zip(x, counts, strict=True):
            for k, n in count.items():
                row[k] = 1.0
                if self.signs[k] > 0:
                    row[-2] += n
                    row[-1] += 1
        x[:, -2:] = np.log1p(x[:, -2:])
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, x = np.zeros((len(x), 0)), x.astype(float)
        for w in self.models:
            out = np.hstack([out, predict(w, np.hstack([x, out]))[:, None]])
        return out


def fit_chain(view: Callable[[int], np.ndarray], y: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """A model for each column of ``y``; the models after the first are trained on out-of-fold probabilities.

    ``view(0)`` are the features by the terms of all documents, ``view(f + 1)`` by those chosen without fold f; only one is held at a time.
    """
    earlier, models = np.zeros((len(y), 0), np.float32), []
    for k in range(y.shape[1]):
        models.append(fit_logistic(np.hstack([view(0), earlier]), y[:, k], 2.0, 120))
        if k + 1 == y.shape[1]:
            break
        held = np.zeros(len(y))
        for f in range(FOLDS):
            out, z = folds == f, np.hstack([view(f + 1), earlier])
            if out.any():
                held[out] = predict(fit_logistic(z[~out], y[~out, k], 2.0, 120), z[out])
        earlier = np.hstack([earlier, held[:, None].astype(np.float32)])
    return models


def chosen_terms(each: DataFrame) -> list[tuple[list[bytes], list[float]]]:
    """Terms and signs by all of (fold, y, w), then without each fold."""
    sums = lambda n, y: [F.sum(n).alias("n"), F.sum(y).alias("bad")] + [
        x for f in range(FOLDS) for x in (F.sum(F.when(F.col("fold") == f, n).otherwise(0)).alias(f"n{f}"), F.sum(F.when(F.col("fold") == f, y).otherwise(0)).alias(f"bad{f}"))
    ]
    one = F.lit(1)
    total = each.agg(*sums(one, F.col("y"))).first()
    by_term = cut(each.select("fold", "y", F.explode("w").alias("w")).groupBy("w").agg(*sums(one, F.col("y"))).where(F.col("n") >= LEAST_DOCS))
    found = []
    for f in ("", *range(FOLDS)):
        less = lambda c, f=f: F.col(c) - F.col(f"{c}{f}") if f != "" else F.col(c)
        count, ones = ((total[c] or 0) - ((total[f"{c}{f}"] or 0) if f != "" else 0) for c in ("n", "bad"))
        n, bad = less("n"), less("bad")
        high, low = (bad + 0.1) / (float(ones) + 1), (n - bad + 0.1) / (float(count - ones) + 1)
        weight = F.round(F.abs(F.log(high / low)) * F.sqrt(n), 9).alias("weight")
        top = by_term.where(n >= LEAST_DOCS).select("w", (high - low).alias("gap"), weight).orderBy(F.desc("weight"), "w").limit(VOCABULARY).collect()
        found.append(([bytes(r.w) for r in top], [1.0 if r.gap > 0 else -1.0 for r in top]))
    return found


def count_terms(docs: DataFrame, words: list[bytes], text: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def make():
        get = shared.value.get

        def run(texts):
            out = [Counter(k for k in map(get, terms_of(t)) if k is not None) for t in texts]
            return [[list(c) for c in out], [list(c.values()) for c in out]]

        return run

    schema = pa.schema([("k", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
    return map_columns(docs, [text], make, schema, "k array<int>, n array<bigint>", keep)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", sample: int = SAMPLE_DOCS) -> Chain:
    """A chain from at most ``sample`` labelled documents.

    The labels hold one mark, so the earlier categories are graded from it: toxic documents with at least twice the
    median number of marked terms (severe), with more than one (repeated), and toxic itself, which decides. The marked terms
    of a document are those chosen without its fold. Null labels teach nothing; a document labelled twice takes its larger
    label, and of a repeated id one row counts. Without labels nothing is toxic.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    limit = hash_threshold(marks, "doc_id", sample)
    if limit is None:
        return Chain([], [], [np.append(np.zeros(2 + k), -5.0) for k in range(3)], CATEGORIES)
    marks = marks.where(F.xxhash64("doc_id") <= limit)
    known = docs.where(F.xxhash64("doc_id") <= limit).select("doc_id", F.col(text).alias("t"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int")
    known = known.join(F.broadcast(marks), "doc_id")  # at most `sample` labels
    known = known.groupBy("doc_id", "y").agg(F.min("t").alias("t")).withColumn("fold", fold)

    def make():
        return lambda texts: [[sorted(set(terms_of(t))) for t in texts]]

    each = map_columns(known, ["t"], make, pa.schema([("w", pa.list_(pa.binary()))]), "w array<binary>", ["fold", "y"])
    chosen = chosen_terms(each)
    union = sorted({w for words, _ in chosen for w in words})
    found = count_terms(known, union, "t", ["doc_id", "y", "fold"]).toArrow()  # one for each id at most
    order = np.argsort([str(i) for i in found["doc_id"].to_pylist()], kind="stable")
    folds, toxic = found["fold"].to_numpy()[order], found["y"].to_numpy()[order].astype(float)
    rows = [(found["k"][i].values.to_numpy(), found["n"][i].values.to_numpy()) for i in order.tolist()]
    at = {w: i for i, w in enumerate(union)}

    def view(which: int) -> np.ndarray:
        words, signs = chosen[which]
        place = np.full(len(union), -1)
        place[[at[w] for w in words]] = np.arange(len(words))
        counts = (dict(zip(place[k][place[k] >= 0].tolist(), n[place[k] >= 0].tolist(), strict=True)) for k, n in rows)
        return Chain(words, signs, [], CATEGORIES).features(counts, len(rows))

    marked = np.zeros(len(rows))
    for f in range(FOLDS):
        marked[folds == f] = np.expm1(view(f + 1)[folds == f, -2])
    marked = np.rint(marked)
    middle = np.median(marked[toxic > 0]) if toxic.any() else 0.0
    y = np.stack([toxic * (marked >= max(2.0, 2 * middle)), toxic * (marked >= 2), toxic], 1)
    return Chain(*chosen[0], fit_chain(view, y, folds), CATEGORIES)


def add_toxicity(docs: DataFrame, chain: Chain, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the probability of each category, score (the last one) and predicted (1: toxic).

    Null counts as empty, and an empty text is scored like any other. Rows that repeat come out as often as they came
    in; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def make():
        model = shared.value
        get = {w: i for i, w in enumerate(model.words)}.get

        def run(texts):
            counts = [Counter(k for k in map(get, terms_of(t)) if k is not None) for t in texts]
            p = model.predict(model.features(counts, len(counts)))
            return [*(p[:, k].tolist() for k in range(p.shape[1])), p[:, -1].tolist(), (p[:, -1] >= THRESHOLD).astype(int).tolist()]

        return run

    names = [f"p_{c}" for c in chain.categories] + ["score"]
    schema = pa.schema([(x, pa.float64()) for x in names] + [("predicted", pa.int32())])
    return map_columns(docs, [text], make, schema, ", ".join(f"{x} double" for x in names) + ", predicted int", keep)


def drop_toxic(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with the columns of ``docs``, whatever their names."""
    plain, name, back = neutral(docs)
    return back(add_toxicity(plain, chain, name[text], plain.columns).where("predicted = 0"))


def op10_toxicity(spark, sf_dir):
    """Learns from labels whose crc32(doc_id as text) mod 5 is not 0; the others, held_out, tell how well it does."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = add_toxicity(docs, fit(docs, labels.where(id_remainder("doc_id", 5) != 0)))
    return found.withColumn("held_out", id_remainder("doc_id", 5) == 0)
