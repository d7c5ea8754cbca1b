"""Repeated runs of text, found by winnowing and deleted where they occur again. DataFrame functions only.

A text is a sequence of words, and its lines are runs of words as well. Two kinds of runs go where they occurred before, in
the order of (doc_id, text hash, word): every run of RUN_WORDS words or more, wherever it starts and ends, and every whole
line of LINE_CHARS characters or more.

Hashes of lines alone miss a passage inside a longer line, so runs are found by winnowing. In every window of words, as many as
there are shingles of SHINGLE words in a run, the word with the least hash is selected; the hash of the shingle that it begins is
the fingerprint. RUN_WORDS words hold a whole window and that shingle, so equal runs select the same word, which makes these
guaranteed fingerprints. Neighbouring windows mostly select the same word; such a stretch, about one for 10 words, is the only
thing that leaves a document:

1. Stretches are joined by fingerprint. One whose fingerprint stands nowhere else is dropped.
2. A stretch is extended both ways to all words that its windows reach, and compared as a whole. Inside a repeated passage
   stretches are equal, so they go here but for those at its ends. Lines are compared as a whole likewise.
3. Where a fingerprint has different stretches, the first of each is extended word by word, and each run of RUN_WORDS words
   in it is compared. Later stretches equal to it hold the same runs, so nothing else needs a look.

No pair of occurrences is ever listed, and no repeated run is missed. Runs count as equal if two 64-bit hashes of their words
agree (for a stretch, the fingerprint and a hash of all its words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import discard, neutral, stored

#: Words of a run that is deleted when it repeats, at least.
RUN_WORDS = 35
#: Characters of a whole line that is deleted when it repeats, at least, without the white space at its ends.
#: Brackets, bullets and rules of a few characters mark structure and stay.
LINE_CHARS = 6
#: A key of a join with more than 1 in HOT of the rows is dealt to SALTS places; there are less than HOT such keys.
HOT, SALTS = 1000, 64
#: What is deleted, in the order of their deletion: lines, stretches, single runs.
LINE, STRETCH, SINGLE = 0, 1, 2
#: Words of a fingerprint; a window has a word for each such shingle in a run.
SHINGLE = 8
#: White space, and the characters of scripts without spaces (Thai, Lao, Tibetan, Burmese, Khmer, kana, Chinese), each a word.
SPACE = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ALONE = r"\x{e00}-\x{fff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"
WORD = f"[{ALONE}]|[^{SPACE}{ALONE}]+"
#: A word with the white space after it, the first one also with that before it; joined they are the text.
TOKEN = f"[{SPACE}]*(?:{WORD})[{SPACE}]*"
#: Texts without such characters have the same words by these plainer patterns, which are three times as fast.
FOREIGN = r"[\x{85}\x{a0}\x{e00}-\x{10ffff}]"
PLAIN_WORD = r"\S+"
PLAIN_TOKEN = r"\s*\S+\s*"
#: The characters of SPACE.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def matches(text: str, pattern: str, plain: str) -> F.Column:
    found = lambda x: F.regexp_extract_all(F.col(text), F.lit(x), F.lit(0))
    return F.when(F.col(text).rlike(FOREIGN), found(pattern)).otherwise(found(plain))


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, t, x): id, hash and text of the rows with a text."""
    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("x"))


def places(count: F.Column) -> F.Column:
    """A row for each number from 0 to ``count`` - 1.

    What follows runs as compiled code on the arrays of the row, which it need not copy. An array function with a lambda
    in the same step would prevent that, and so would an exploded column, whose expression Spark would evaluate again
    to leave out empty arrays.
    """
    return F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)))


def runs_of(docs: DataFrame, run_words: int, line_chars: int) -> DataFrame:
    """(d, t, lo, hi, fp, kind, line): the stretches of texts (d, t, x), by their first and last words, and the long lines, by their number.

    ``fp`` is the fingerprint of a stretch or a hash of a line, ``kind`` another hash of all its words. Blank lines have no number.
    """
    window = run_words - SHINGLE + 1
    bare = F.filter(F.transform(F.split("x", "\n"), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")
    words = docs.select("d", "t", bare.alias("lines"), matches("x", WORD, PLAIN_WORD).alias("u"))
    words = words.select("d", "t", "lines", F.transform("u", lambda x: F.xxhash64(x)).alias("h"))
    w, i, lo, hi, at = (F.col(c) for c in ("w", "i", "lo", "hi", "at"))
    words = words.withColumn("w", F.greatest(F.lit(0), F.size("h") - (run_words - 1)))
    each = words.select("d", "t", "h", "lines", "w", places(w + F.size("lines")).alias("i"))
    h, part = lambda n: F.get(F.col("h"), n), lambda n, size: F.slice("h", n + 1, size)
    line, end = F.get(F.col("lines"), i - w), i + (window - 1)
    # A window selects another word than the one before it if its last word has less than all others, or the one before its
    # first no more than these.
    inner = F.array_min(part(i, F.lit(window - 1))) if window > 1 else F.lit((1 << 63) - 1)
    new = (i == 0) | (inner >= F.least(h(i - 1), F.try_add(h(end), F.lit(1))))
    found = each.where(F.when(i >= w, F.length(line) >= line_chars).otherwise(new))
    found = found.withColumn("least", F.when(i < w, F.least(inner, h(end))))
    found = found.withColumn("at", i + (F.array_position(part(i, F.lit(window)), F.col("least")) - 1).cast("int")).withColumn("held", F.lit(0))
    # How many words after it have no less, by halving; the last window that selects it ends before the first that has less.
    for step in (1 << k for k in reversed(range((window - 1).bit_length()))):
        more = F.coalesce(F.array_min(part(at + 1 + F.col("held"), F.lit(step))) >= F.col("least"), F.lit(True))
        found = found.withColumn("held", F.col("held") + F.when(more, step).otherwise(0))
    last = F.least(w - 1, at + F.least(F.col("held"), F.lit(window - 1)) - (window - 1)) + (run_words - 1)
    found = found.select("d", "t", "h", "at", line.alias("line"), F.when(i < w, i).otherwise(i - w).alias("lo"), F.when(i < w, last).otherwise(i - w).alias("hi"))
    fp = F.when(at.isNull(), F.xxhash64("line")).otherwise(F.xxhash64(part(at, F.lit(SHINGLE))))
    kind = F.when(at.isNull(), F.xxhash64("line", F.lit(1))).otherwise(F.xxhash64(F.lit(1), part(lo, hi - lo + 1)))
    return found.select("d", "t", "lo", "hi", fp.alias("fp"), kind.alias("kind"), at.isNull().alias("line"))


def single_runs(near: DataFrame, run_words: int) -> DataFrame:
    """(d, t, lo, k1, k2): the runs in the stretches ``r`` of texts (d, t, x), and two hashes of the words of each."""
    starts = F.array_distinct(F.flatten(F.transform("r", lambda v: F.sequence(v.lo, v.hi - (run_words - 1)))))
    words = near.select("d", "t", starts.alias("starts"), matches("x", WORD, PLAIN_WORD).alias("u"))
    words = words.select("d", "t", "starts", F.transform("u", lambda x: F.xxhash64(x)).alias("h"))
    each = words.select("d", "t", "h", "starts", places(F.size("starts")).alias("i")).select("d", "t", "h", F.get("starts", F.col("i")).alias("lo"))
    run = F.slice("h", F.col("lo") + 1, F.lit(run_words))
    return each.select("d", "t", "lo", F.xxhash64(run).alias("k1"), F.xxhash64(F.lit(1), run).alias("k2"))


def spread_join(many: DataFrame, groups: DataFrame, key: list[str], total: int) -> DataFrame:
    """``many`` joined by ``key`` with ``groups``, one row a key with its number ``rows`` of rows in ``many``.

    Keys with more than 1 in HOT of the ``total`` rows, HOT at most, are dealt to SALTS places, where ``groups`` repeats.
    """
    hot = F.col("rows") * HOT > F.lit(total)
    marks = F.broadcast(groups.where(hot).select(*key, F.lit(True).alias("__hot")))
    salted = many.join(marks, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64("d", "t", "lo"), F.lit(SALTS))).otherwise(0)).drop("__hot")
    copied = groups.select(*groups.columns, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("__salt"))
    return salted.join(copied, [*key, "__salt"]).drop("__salt", "rows")


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, line_chars: int = LINE_CHARS) -> DataFrame:
    """(d, t, spans), stored: for documents with runs that occurred before these as sorted structs (of, lo, hi): first and last words, or line numbers."""
    texts = named(docs, doc_id, text)
    runs = stored(runs_of(texts, run_words, line_chars), "runs")
    place, spot = F.struct("d", "t", "lo"), F.xxhash64("d", "t", "lo")
    # Fingerprints, and lines, at two places or more; mixed: the stretches differ.
    prints = runs.groupBy("fp", "line").agg(F.min(spot).alias("s0"), F.max(spot).alias("s1"), F.min("kind").alias("k0"), F.max("kind").alias("k1"), F.count("*").alias("rows"))
    prints = stored(prints.where("s0 <> s1").select("fp", "line", "rows", F.expr("k0 <> k1 and not line").alias("mixed")), "prints")
    close = stored(spread_join(runs, prints, ["fp", "line"], runs.count()), "close-runs")
    discard(runs, prints)
    key = ["fp", "kind", "line"]
    firsts = close.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("mixed").alias("mixed"), F.max(F.expr("hi - lo")).alias("more"), F.count("*").alias("rows"))
    firsts = stored(firsts, "first-runs")
    again = firsts.where(~F.col("first").eqNullSafe(F.col("last"))).select(*key, "first", "rows")
    whole = spread_join(close.drop("mixed"), again, key, close.count()).where(~place.eqNullSafe(F.col("first"))).select("d", "t", F.when(F.col("line"), LINE).otherwise(STRETCH).alias("of"), "lo", "hi")
    # The first stretch of each kind under a mixed fingerprint, run by run.
    heads = firsts.where("mixed").select("first.d", "first.t", F.struct("first.lo", (F.col("first.lo") + F.col("more")).alias("hi")).alias("v"))
    heads = heads.groupBy(F.col("d").alias("d2"), F.col("t").alias("t2")).agg(F.collect_set("v").alias("r"))
    near = texts.join(heads, F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2"))).select("d", "t", "x", "r")
    single = stored(single_runs(near, run_words), "single-runs")
    before = single.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("rows"))
    before = stored(before.where(~F.col("first").eqNullSafe(F.col("last"))).select("k1", "k2", "first", "rows"), "repeated-single-runs")
    later = spread_join(single, before, ["k1", "k2"], single.count()).where(~place.eqNullSafe(F.col("first")))
    later = later.select("d", "t", F.lit(SINGLE).alias("of"), "lo", (F.col("lo") + (run_words - 1)).alias("hi"))
    spans = whole.unionAll(later).groupBy("d", "t").agg(F.sort_array(F.collect_set(F.struct("of", "lo", "hi"))).alias("spans"))
    spans = stored(spans, "gone")
    discard(close, firsts, single, before)
    return spans


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, line_chars: int = LINE_CHARS,
) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, and the column __n_gone, the number of words deleted.

    Words are what white space parts, and single characters of scripts without spaces; they are compared as they stand, the
    white space between them isn't. A word goes with the white space after it. Every row stays, if with an empty text. Null
    texts stay null. Rows with the same id and text are one document and come out alike; a null id sorts
    before all others. Of a text that repeats itself with overlaps one period stays. Other columns pass through under any
    names, but for that of the added one, which is replaced. An empty table gives an empty result.
    """
    gone = repeated_runs(docs, doc_id, text, run_words, line_chars)
    gone = gone.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("spans").alias("__spans"))
    plain, name, _ = neutral(docs)
    body = F.col(name[text])
    same = F.col(name[doc_id]).eqNullSafe(F.col("__d")) & (F.xxhash64(body) == F.col("__t"))
    # Columns of their own, used several times, are evaluated once a row and not again inside the lambda below.
    joined = plain.join(gone, same, "left").withColumn("__tokens", F.when(F.col("__spans").isNotNull(), matches(name[text], TOKEN, PLAIN_TOKEN)))
    tokens, spans = F.col("__tokens"), F.col("__spans")
    # The first word of each line; a line's words are those up to the next one's.
    ends = lambda x, i: x.contains("\n") & ((i > 0) | F.ltrim(x, F.lit(SPACES)).contains("\n"))
    after = F.array_compact(F.transform("__tokens", lambda x, i: F.when(ends(x, i), i + 1)))
    joined = joined.withColumn("__starts", F.when(F.get(spans, F.lit(0))["of"] == LINE, F.concat(F.array(F.lit(0)), after, F.array(F.size(tokens)))))
    at = lambda j: F.get(F.col("__starts"), j)
    # Stretches end in the order in which they begin, and so do single runs, so each is listed up to where the next one begins.
    next_ = lambda j: F.get(spans, j + 1)
    hi = lambda v, j: F.when(next_(j)["of"] == v.of, F.least(v.hi, next_(j)["lo"] - 1)).otherwise(v.hi)
    listed = F.transform("__spans", lambda v, j: F.when(v.of == LINE, F.sequence(at(v.lo), at(v.lo + 1) - 1)).otherwise(F.sequence(v.lo, hi(v, j))))
    numbers = F.flatten(listed)
    joined = joined.withColumn("__kept", F.array_except(F.sequence(F.lit(0), F.size(tokens) - 1), numbers))
    rest = F.array_join(F.transform("__kept", lambda i: F.get(tokens, i)), "")
    out = {
        text: F.when(tokens.isNull(), body).otherwise(rest),
        "__n_gone": F.when(tokens.isNotNull(), F.size(tokens) - F.size("__kept")).otherwise(F.lit(0)).cast("long"),
    }
    names = [c for c in docs.columns if c.lower() not in {k.lower() for k in out}]
    return joined.select(*(F.col(name[c]).alias(c) for c in names), *(v.alias(k) for k, v in out.items()))


def op8_linededup(spark, sf_dir):
    found = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return found.select("doc_id", F.col("__n_gone").alias("n_removed"), digest.alias("text_sha256"))


SPACES_SQL = "' || " + " || ".join(f"chr({ord(c)})" for c in SPACES) + " || '"

OP8_SQL = f"""
WITH split AS (SELECT doc_id AS d, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS a FROM documents),
flat AS (SELECT d, unnest(a) AS x, unnest(range(len(a))) AS p FROM split),
bare AS (SELECT d, p, x, regexp_extract(x, '{WORD}') AS w,
  coalesce(sum(CASE WHEN contains(ltrim(x, '{SPACES_SQL}'), chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM flat),
words AS (SELECT d, list(w ORDER BY p) AS w FROM bare GROUP BY 1),
runs AS (SELECT d, s, s + {RUN_WORDS - 1} AS e, array_to_string(w[s + 1:s + {RUN_WORDS}], ' ') AS k, 'run' AS kind
  FROM (SELECT d, w, unnest(range(len(w) - {RUN_WORDS - 1})) AS s FROM words WHERE len(w) >= {RUN_WORDS})
  UNION ALL
  SELECT d, min(p), max(p), trim(string_agg(x, '' ORDER BY p), '{SPACES_SQL}'), 'line' FROM bare GROUP BY d, line HAVING len(trim(string_agg(x, '' ORDER BY p), '{SPACES_SQL}')) >= {LINE_CHARS}),
ranked AS (SELECT *, first_value(d) OVER (PARTITION BY kind, k ORDER BY d, s) AS fd, first_value(s) OVER (PARTITION BY kind, k ORDER BY d, s) AS fs FROM runs),
gone AS (SELECT DISTINCT d, unnest(range(s, e + 1)) AS p FROM ranked WHERE d <> fd OR s <> fs),
lost AS (SELECT d, count(*) AS n FROM gone GROUP BY 1),
rest AS (SELECT f.d, string_agg(f.x, '' ORDER BY f.p) AS x FROM flat f ANTI JOIN gone g ON g.d = f.d AND g.p = f.p GROUP BY 1)
SELECT o.doc_id, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN lost.n IS NULL THEN coalesce(o.text, '') ELSE coalesce(rest.x, '') END) AS text_sha256
FROM documents o LEFT JOIN lost ON lost.d = o.doc_id LEFT JOIN rest ON rest.d = o.doc_id
"""
