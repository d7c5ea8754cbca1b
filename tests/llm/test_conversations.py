"""Prefix trie, chat formatting and tokenizer alignment against brute force, with nulls, ties, repeats, long rows and other columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sigloom.llm import align, chat, trie

TURNS = "conv_id long, turn long, role string, text string, c long, part string"


def turns_of():
    """Shared beginnings, repeated rows, null and equal turns, null roles and texts, a long conversation, ids below zero."""
    r = random.Random(3)
    say = ["hi", "", None, "é 漢", "yes\nno", "x" * 3000]
    rows = []
    for c in [*range(0, 60), 100, 101, 107, -1, -4, -5, -6]:
        r2 = random.Random(c % 7)
        for t in range(r.randrange(1, 12)):
            rows.append((c, t, r2.choice(["user", "assistant", None]), r2.choice(say) if t < 4 else r.choice(say)))
    rows += [(5, None, "user", "before"), (5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (6, 0, "user", "hi"), (6, 0, "user", "hi")]
    rows += [(400, t, "user", str(t % 3)) for t in range(3000)] + [(401, t, "user", "a") for t in range(2)] + [(None, 0, "user", "of none")]
    return [(*row, 1, "p") for row in rows]


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = convs.get(base, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        key = hashlib.md5(b"").hexdigest()
        path = [(0, key)]
        for d, (r, x) in enumerate(built[c], 1):
            key = hashlib.md5(f"{key}{len(r)}:{r}{x}".encode()).hexdigest()
            path.append((d, key))
        for p in path:
            members[p].append((c, path))
        ends[path[-1]].append(c)
    out = []
    weight = {p: len(built[m[0][0]][p[0] - 1][1].encode()) if p[0] else 0 for p, m in members.items()}
    for p, m in members.items():
        below = {q for _, path in m for q in path[p[0] :]}
        kids = {q for q in below if q[0] == p[0] + 1}
        inner = {path[i] for _, path in m for i in range(len(path) - 1)}
        up = members[m[0][1][p[0] - 1]][0][0] if p[0] else None
        saved = sum((len(members[q]) - 1) * weight[q] for q in below)
        out.append((m[0][0], p[0], up, len(m), len(kids), len(below - inner), saved, hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("hot", [1000, 1])
def test_trie_is_that_of_brute_force(spark, monkeypatch, many_parts, hot):
    monkeypatch.setattr(trie, "HOT", hot)
    monkeypatch.setattr(trie, "CHUNK_BITS", 2)
    rows = turns_of()
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    got = trie.prefix_trie(*trie.with_borrowed_heads(trie.ordered_turns(df))).collect()
    assert sorted(map(tuple, got), key=lambda x: x[:2]) == brute_trie(rows)


def test_a_long_conversation_lies_in_several_parts(spark, many_parts):
    df = spark.createDataFrame([(1, t, "user", "same") for t in range(4000)], "conv_id long, turn long, role string, text string")
    ranked = trie.ordered_turns(df)
    assert ranked.select("part").distinct().count() > 1
    assert [r.rank for r in ranked.orderBy("rank").collect()] == list(range(1, 4001))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(*trie.with_borrowed_heads(trie.ordered_turns(none))).count() == 0


def test_chats_come_back(spark):
    r = random.Random(4)
    bits = ["<turn user>", "</turn>", "\\", "<", "<image>", "<\\part>", "text", "\n", "&gt;", "<audio", "é", " ", "<document>>", "ok"]
    rows = [(c, t, r.choice(["user", "assistant", None, "a>b&c</turn>\n<turn x>"]), "".join(r.choices(bits, k=r.randrange(6)))) for c in range(40) for t in range(r.randrange(1, 7))]
    rows += [(50, None, "assistant", None), (50, 0, "user", "x" * 100_000), (51, 1, "user", "b"), (51, 1, "user", "a"), (51, 1, "user", "a"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    chats = chat.format_chats(df.withColumn("parts", chat.parts_of(F.coalesce("text", F.lit("")))))
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    got = chat.read_chats(chats).collect()
    assert len(got) == len(want)
    for row in got:
        one = sorted(want[row.conv_id])
        turns = [(t.role, t.text) for t in row.turns]
        assert sorted(turns) == sorted(x[2:] for x in one)
        if row.conv_id not in (50, 51):
            assert turns == [x[2:] for x in one]
        assert "".join(row.learned) == "".join(text for role, text in turns if role == "assistant")
    first = {row.conv_id: row for row in got}
    assert [t.text for t in first[51].turns] == ["a", "a", "b"] and first[50].turns[0].role == "assistant"
    runs = {row.conv_id: row for row in chats.collect()}
    assert sum(a + b for a, b in runs[3].loss_runs) + 8 * len(runs[3].loss_runs) == len(runs[3].formatted)


def test_attachments_are_parts(spark):
    text = "see ![a cat](http://x/cat.png#tiles=3) and [talk](t.wav#12)![b](b.png) [paper](p.pdf#pages=2) [page](http://x/y) <image>"
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", f"![c](c.png){text}")], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df.withColumn("parts", chat.parts_of(F.col("text"))))
    row = chats.first()
    assert row.formatted.startswith("<turn user>\nsee <image> and <audio><image> <document> [page](http://x/y) <\\image></turn>\n<turn assistant>\n<image>see ")
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in row.attachments][:5] == [
        (0, "image", "http://x/cat.png#tiles=3", 768), (0, "audio", "t.wav#12", 300), (0, "image", "b.png", 256), (0, "document", "p.pdf#pages=2", 1024), (1, "image", "c.png", 256),
    ]
    back = chat.read_chats(chats).first()
    assert [t.text for t in back.turns] == [text, f"![c](c.png){text}"] and back.learned == ["", f"![c](c.png){text}"]


def test_texts_that_touch_stay_apart(spark):
    parts = [("text", "<tu", None, 0), ("text", "rn user>\\", None, 0), ("image", "I", "i", 2), ("text", "", None, 0), ("text", None, None, 0), ("other", "D", "d", None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "assistant", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.read_chats(chat.format_chats(df)).first()
    assert [t.text for t in row.turns] == ["<turn user>\\ID", "", ""] and row.learned == ["<turn user>\\ID", "", ""]
    assert [(a.kind, a.tokens) for a in row.attachments] == [("image", 512), ("document", 512)]


def test_no_chat(spark):
    none = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.read_chats(chat.format_chats(none)).count() == 0


def brute_alignment(texts):
    pair = align.load("byte_bpe_50k.json", "piece_bpe_32k.model")

    def one(text):
        if not text:
            return None
        data = (" " + text).encode()
        a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        xa, xb = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
        if b"".join(xa) != data or b"".join(xb) != data:
            return None
        ends = []
        for x in (xa, xb):
            at = 0
            ends.append([at := at + len(t) for t in x])
        links = [
            (p, q) for i, p in enumerate(a) for j, q in enumerate(b)
            if max(ends[0][i] - len(xa[i]), ends[1][j] - len(xb[j])) < min(ends[0][i], ends[1][j])
        ] if len(a) < 400 else None
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            i, j = k, m
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    found = [one(t) for t in texts]
    counts, top = Counter(), defaultdict(int)
    for f in found:
        counts.update(set(f[3]) if f else ())
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return counts, [
        (0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(counts[x] == top[x[0]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for f in found
    ]


def odd_texts():
    r = random.Random(6)
    bits = ["word", " ", "  ", "\n", "\t", "　", "\x1c", "\x85", "\xa0", ",", "naïve", "漢字", "😀", "▁", "<|endoftext|>", "</s>", "<0x41>", "'s", "12", "\r\n", "é", "\x00"]
    texts = ["".join(r.choices(bits, k=r.randrange(1, 12))) for _ in range(400)]
    return [None, "", " ", "\n", "a ", " a", "  a  b  ", "a\n b", *texts, "same words here", "same words here", "z" * 300, "one two " * 40]


def test_alignment_is_that_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_BYTES", 500)
    monkeypatch.setattr(align, "SHARD_BYTES", 1000)
    monkeypatch.setattr(align, "CALL_CHARS", 40)
    texts = odd_texts()
    rows = [(i if i != 5 else None, t, 0) for i, t in enumerate(texts)]
    got, counts = align.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string, block int"))
    got = {r.doc_id: r for r in got.collect()}
    want_counts, want = brute_alignment(texts)
    for i, w in enumerate(want):
        r = got[i if i != 5 else None]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, repr(texts[i])
    assert {(r.a, r.b): r["count"] for r in counts.collect()} == dict(want_counts)


def test_segments_are_put_together_again():
    for t in odd_texts():
        if t:
            assert " ".join(align.segments(t)) == t
    assert align.load("byte_bpe_50k.json", "piece_bpe_32k.model").splits


def test_alignment_of_nothing(spark):
    docs, counts = align.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"))
    assert docs.count() == 0 and counts.count() == 0
    docs, counts = align.align_tokenizers(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string"))
    assert [tuple(r)[:4] for r in docs.collect()] == [(1, 0, 0, 0)] * 2 and counts.count() == 0
