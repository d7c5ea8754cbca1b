"""Language identification of mixed-language text.

Script ranges narrow a word's candidate languages, n-gram counts score the word for each of them, and Viterbi with a
penalty for switching labels the words, so that spans of different languages in one text come apart.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import hash_threshold, id_remainder, map_columns

#: First code point of each block range and the script it belongs to; letters before 0x370 are Latin.
SCRIPT_STARTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB1D, 0xFB50, 0xFF00, 0xFF66, 0x20000)
SCRIPT_NAMES = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "indic", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "han", "kana", "other", "han", "other", "hangul", "other", "han", "latin", "hebrew", "arabic", "latin", "kana", "han")

#: Training documents at most; chosen by the hash of the id.
SAMPLE_DOCS = 3000
#: n-grams of the model at most, the most frequent first, among this many hash buckets; others count as unseen in every language.
MODEL_GRAMS, BUCKETS = 80_000, 1 << 18
LONGEST_GRAM = 3
#: Natural-log units that a change of language has to earn.
SWITCH = 9.0
#: One word's evidence against a language at most. Three such words among others make a span of their own.
WORD_LIMIT = 8.0
#: Evidence against a language that isn't written in a word's script: enough for a span of one word.
OTHER_SCRIPT = 2 * SWITCH + 1
#: Letters scored at a time, and the rest of the word that they end in.
BLOCK = 65_536


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its small letter, or 0 where it is no letter, and the number of its script."""
    small = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            small[c] = ord(low) if len(low) == 1 else c
    script = np.searchsorted(np.array(SCRIPT_STARTS), np.arange(0x110000), "right") - 1
    names = sorted(set(SCRIPT_NAMES))
    return small, np.array([names.index(x) for x in SCRIPT_NAMES], np.uint8)[script]


def letters_of(text: str) -> np.ndarray:
    """Small letters of a text as code points; 0 stands for everything else."""
    return letter_tables()[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def gram_buckets(letters: np.ndarray) -> list[np.ndarray]:
    """For each order 1 to LONGEST_GRAM the bucket of the n-gram ending at each place, with 0 before a word."""
    out, mixed = [], np.zeros(len(letters), np.uint64)
    for n in range(LONGEST_GRAM):
        back = letters if not n else np.concatenate((np.zeros(min(n, len(letters)), np.uint32), letters[:-n]))
        mixed = (mixed + back.astype(np.uint64) + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        out.append((mixed >> np.uint64(20)) & np.uint64(BUCKETS - 1))
    return [x.astype(np.int64) for x in out]


class Model:
    """Per-language log probabilities of n-gram buckets, and the scripts each language is written in."""

    def __init__(self, counts: list[tuple[str, int, int]], scripts: list[tuple[str, int, int]]):
        self.langs = sorted({row[0] for row in [*counts, *scripts]})
        at = {x: i for i, x in enumerate(self.langs)}
        seen = np.zeros((BUCKETS, len(at)))
        for lang, bucket, n in counts:
            seen[bucket, at[lang]] += n
        self.logp = (np.log(seen + 0.5) - np.log(seen.sum(0) + 0.5 * (len(counts) + 1))).astype(np.float32)
        letters = np.zeros((256, len(at)))
        for lang, script, n in scripts:
            letters[script, at[lang]] += n
        #: A script is a language's if it has a hundredth of the language's letters; one that no language has narrows nothing.
        self.written = letters > 0.01 * letters.sum(0)
        self.written[~self.written.any(1)] = True

    def word_scores(self, letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row for each word: log-probability less the best language's, 0 for the best, down to -WORD_LIMIT.

        Languages that the word's script excludes don't count as best and get -OTHER_SCRIPT.
        """
        score = np.zeros((len(starts), len(self.langs)), np.float32)
        for bucket in gram_buckets(letters):
            each = self.logp[bucket]
            each[letters == 0] = 0
            score += np.add.reduceat(each, starts, 0)
        fits = self.written[letter_tables()[1][letters[starts]]]
        best = np.where(fits, score, -np.inf).max(1, keepdims=True)
        return np.where(fits, np.maximum(score - best, -WORD_LIMIT), -OTHER_SCRIPT)


def word_starts(letters: np.ndarray) -> np.ndarray:
    is_letter = letters > 0
    return np.flatnonzero(is_letter & ~np.concatenate(([False], is_letter[:-1])))


def word_blocks(letters: np.ndarray):
    """(start, end) of stretches of BLOCK letters and the rest of the word at their end."""
    gaps, at = np.flatnonzero(letters == 0), 0
    while at < len(letters):
        k = int(np.searchsorted(gaps, at + BLOCK - 1))
        end = int(gaps[k]) + 1 if k < len(gaps) else len(letters)
        yield at, end
        at = end


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word (row); a change from one row to the next costs ``switch``. Ties: the first.

    If no language gains more than half the penalty over the best one on any stretch, staying is best: a path of m
    stretches in other languages changes at least m times, or m - 1 times, m at least 2, if it never comes back.
    """
    totals = scores.sum(0)
    best = int(totals.argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], 0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gain[:-1]]), 0)
    if (gain - low).max() <= switch / 2:
        return np.full(len(scores), best)
    # Only values less the leading one matter, and they stay between -switch and 0.
    rows = scores.tolist()
    now, tops, moves = rows[0], [0], [()]
    for row in rows[1:]:
        lead = max(now)
        jump = lead - switch
        tops.append(now.index(lead))
        moves.append([x < jump for x in now] if min(now) < jump else ())
        now = [(x if x >= jump else jump) - lead + y for x, y in zip(now, row)]
    lang = now.index(max(now))
    path = [lang] * len(rows)
    for i in range(len(rows) - 1, 0, -1):
        if moves[i] and moves[i][lang]:
            lang = tops[i]
        path[i - 1] = lang
    return np.array(path)


class Tagger:
    """Labels texts with a fitted model."""

    def __init__(self, model: Model):
        self.model = model

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of letters and language of each word of a whole text."""
        letters = letters_of(text)
        starts, scores = [], []
        for at, end in word_blocks(letters) if self.model.langs else ():
            found = word_starts(letters[at:end])
            if len(found):
                scores.append(self.model.word_scores(letters[at:end], found))
                starts.append(found + at)
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.concatenate(starts)
        return start, np.add.reduceat((letters > 0).astype(np.int64), start), viterbi(np.concatenate(scores))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of each stretch of one language, from its first to its last letter."""
        start, size, lang = self.words(text)
        out = []
        for first in np.flatnonzero(np.diff(lang, prepend=-1)):
            same = np.flatnonzero(lang[first:] != lang[first])
            last = first + (int(same[0]) if len(same) else len(lang) - first) - 1
            out.append((int(start[first]), int(start[last] + size[last]), self.model.langs[lang[first]]))
        return out

    def label(self, text: str | None) -> tuple[str, float]:
        """The language with most letters, and its share of the letters."""
        _, size, lang = self.words(text or "")
        if not len(size):
            return "und", 0.0
        letters = np.bincount(lang, weights=size, minlength=len(self.model.langs))
        best = int(letters.argmax())
        return self.model.langs[best], float(letters[best] / letters.sum())


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> Model:
    """Counts n-grams over whole texts of at most ``sample`` documents with a language and a text."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    limit = hash_threshold(known, doc_id, sample)
    if limit is None:
        return Model([], [])

    def make():
        scripts = letter_tables()[1]

        def run(langs, texts):
            seen: dict[str, np.ndarray] = {}
            for x, t in zip(langs, texts, strict=True):
                count = seen.setdefault(x, np.zeros(BUCKETS + 256, np.int64))
                letters = letters_of(t)
                for at, end in word_blocks(letters):
                    part = letters[at:end]
                    for bucket in gram_buckets(part):
                        count[:BUCKETS] += np.bincount(bucket[part > 0], minlength=BUCKETS)
                    count[BUCKETS:] += np.bincount(scripts[part[part > 0]], minlength=256)
            rows = [{"lang": x, "b": int(k), "n": int(c[k])} for x, c in seen.items() for k in np.flatnonzero(c)]
            return [[rows] + [[]] * (len(texts) - 1)]

        return run

    item = pa.struct([("lang", pa.string()), ("b", pa.int64()), ("n", pa.int64())])
    counted = map_columns(
        known.where(F.xxhash64(doc_id) <= limit), [lang, text], make, pa.schema([("c", pa.list_(item))]),
        "c array<struct<lang:string,b:bigint,n:bigint>>",
    )
    counts = counted.select(F.explode("c").alias("c")).groupBy("c.lang", "c.b").agg(F.sum("c.n").alias("n"))
    rows = [tuple(r) for r in counts.orderBy(F.col("b") < BUCKETS, F.desc("n"), "lang", "b").limit(MODEL_GRAMS).collect()]
    return Model([r for r in rows if r[1] < BUCKETS], [(x, b - BUCKETS, n) for x, b, n in rows if b >= BUCKETS])


def add_language(docs: DataFrame, model: Model, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of every whole text.

    Null texts, texts without a letter and an unfitted model give ``und`` with score 0. Rows that repeat come out as
    often as they came in; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        tagger = Tagger(shared.value)

        def run(texts):
            found = [tagger.label(t) for t in texts]
            return [[x for x, _ in found], [s for _, s in found]]

        return run

    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])
    return map_columns(docs, [text], make, schema, "lang_pred string, score double", keep)


def op2_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(id_remainder("doc_id", 4) != 2))
    found = add_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
