"""Conversations as training text: turns with typed parts, a loss mask, and the way back.

A turn is ``<turn role>``, a line break, its body, ``</turn>`` and a line break. A body has its text parts in order, with
``<image>``, ``<audio>`` or ``<document>`` in the place of an attachment and ``<part>`` between two texts that touch. The only
change to a text is one backslash after the ``<`` of what would read as one of these strings (with more backslashes if
some stood there), so it can be undone. In a role, & and > become &amp; and &gt;.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import table

NAMES = "(?:turn|image|audio|document|part)\\b"
CONTROL = f"<(\\\\*/?{NAMES})"
ESCAPED = f"<\\\\(\\\\*/?{NAMES})"
CUT = "<(?:image|audio|document|part)>"
END = "</turn>\n"
#: Markdown images, and links to files of audio and documents.
ATTACHMENT = r"!\[[^\[\]\n]*\]\([^()\s]+\)|\[[^\[\]\n]*\]\([^()\s]+\.(?:wav|mp3|flac|ogg|pdf|docx?|odt)(?:#[^()\s]*)?\)"
#: Tokens that a unit of each kind stands for: a tile of an image, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,ref:string,units:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "<$1")


def parts_of(text: Column) -> Column:
    """The typed parts of a Markdown text: texts, and attachments with their source as ``text``; empty texts are left out.

    ``#n`` or ``#name=n`` at the end of a reference gives the number of units (at most nine digits), otherwise there is one.
    """

    def attached(source: Column) -> Column:
        ref = F.regexp_extract(source, r"\]\((.*)\)$", 1)
        units = F.coalesce(F.regexp_extract(ref, r"#(?:\w+=)?(\d{1,9})$", 1).try_cast("int"), F.lit(1))
        kind = F.when(source.startswith("!"), "image").when(ref.rlike(r"\.(?:wav|mp3|flac|ogg)(?:#|$)"), "audio").otherwise("document")
        return F.struct(kind.alias("kind"), source.alias("text"), ref.alias("ref"), units.alias("units"))

    def plain(x: Column) -> Column:
        return F.struct(F.lit("text").alias("kind"), x.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units"))

    texts = F.transform(F.split(text, ATTACHMENT, -1), plain)
    found = F.transform(F.regexp_extract_all(text, F.lit(ATTACHMENT), F.lit(0)), attached)
    both = F.filter(F.flatten(F.zip_with(texts, found, lambda a, b: F.array(a, b))), lambda p: p.isNotNull() & (p.text != ""))
    return F.when(text.contains("]("), both).otherwise(F.array(plain(text))).cast(f"array<{PART}>")


def body_of(parts: Column) -> Column:
    """The visitor: every part in order as escaped text or a placeholder; parts of unknown kind count as documents."""

    def visit(p: Column, i: Column) -> Column:
        touches = (i > 0) & (F.get(parts, i - 1).kind == "text")
        text = F.concat(F.when(touches, "<part>").otherwise(""), escape(F.coalesce(p.text, F.lit(""))))
        return F.when(p.kind == "text", text).when(p.kind.isin("image", "audio"), F.concat(F.lit("<"), p.kind, F.lit(">"))).otherwise("<document>")

    one_text = (F.size(parts) == 1) & (F.get(parts, F.lit(0)).kind == "text")
    return F.when(one_text, escape(F.coalesce(F.get(parts, F.lit(0)).text, F.lit("")))).otherwise(F.array_join(F.transform(parts, visit), ""))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", unit_tokens: dict[str, int] = UNIT_TOKENS) -> DataFrame:
    """conv_id, formatted, loss_runs and attachments of each conversation; ``parts`` is an array of PART.

    Turns stand by ``turn`` (null first), those with the same number by their formatted text; repeated rows are turns of their
    own. Null roles, parts and texts are empty. Rows without an id make one conversation, whose id is null. An empty table gives
    no row; other columns are ignored. loss_runs has for each turn the code points to skip and those to learn (none
    unless the role is assistant); the end mark after them is not learned. attachments are in order, each with its turn
    (from 0), kind, reference, source text and the tokens that its placeholder expands to. A conversation has to fit into a row.
    """
    head = F.concat(F.lit("<turn "), F.regexp_replace(F.regexp_replace(F.coalesce(F.col(role), F.lit("")), "&", "&amp;"), ">", "&gt;"), F.lit(">\n"))
    cost = F.create_map(*(F.lit(x) for pair in unit_tokens.items() for x in pair))

    def attached(p: Column) -> Column:
        kind = F.when(p.kind.isin("image", "audio"), p.kind).otherwise("document")
        tokens = F.coalesce(p.units, F.lit(1)).cast("long") * F.coalesce(F.element_at(cost, kind), F.lit(1))
        return F.struct(kind.alias("kind"), p.ref.alias("ref"), F.coalesce(p.text, F.lit("")).alias("source"), tokens.alias("tokens"))

    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("t"), head.alias("head"), F.col(role).eqNullSafe("assistant").alias("learn"),
        F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    rows = rows.withColumn("body", body_of(F.col("parts")))
    keep = F.when(F.col("learn"), F.length("body")).otherwise(0)
    row = F.struct(
        "t", F.concat("head", "body").alias("s"), (F.length("head") + F.length("body") - keep).alias("skip"), keep.alias("keep"), F.transform(F.filter("parts", lambda p: ~p.kind.eqNullSafe("text")), attached).alias("a")
    )
    whole = rows.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    found = F.flatten(F.transform("rows", lambda r, i: F.transform(r.a, lambda a: F.struct(i.alias("turn"), a.kind.alias("kind"), a.ref.alias("ref"), a.source.alias("source"), a.tokens.alias("tokens")))))
    return whole.select(
        "conv_id", F.concat(F.array_join(F.transform("rows", lambda r: r.s), END), F.lit(END)).alias("formatted"),
        F.transform("rows", lambda r: F.struct(r.skip.alias("skip"), r.keep.alias("keep"))).alias("loss_runs"), found.alias("attachments"),
    )


def restored(body: Column, sources: Column) -> Column:
    """The text of a body: escapes undone, and the sources put in the place of the placeholders, in order."""
    marks = F.transform(F.regexp_extract_all(body, F.lit(CUT), F.lit(0)), lambda m: m == "<part>")
    texts = F.transform(F.split(body, CUT, -1), unescape)
    step = lambda s, m: F.when(m, s).otherwise(s + 1)
    numbers = F.transform(F.sequence(F.lit(1), F.size(marks)), lambda i: F.aggregate(F.slice(marks, F.lit(1), i), F.lit(0), step))
    filled = F.zip_with(marks, numbers, lambda m, n: F.when(m, "").otherwise(F.coalesce(F.get(sources, n - 1), F.lit(""))))
    mixed = F.array_join(F.flatten(F.zip_with(texts, filled, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(F.size(marks) > 0, mixed).otherwise(unescape(body))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and learned (the text under the mask of each turn), read from what format_chats gives."""
    pieces = F.split(F.col("formatted"), END, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    split = chats.withColumn("pieces", pieces)
    role = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_extract(p, "^<turn ([^>]*)>\n", 1), "&gt;", ">"), "&amp;", "&")
    body = lambda p: F.regexp_replace(p, "^<turn [^>]*>\n", "")
    sources = lambda i: F.transform(F.filter("attachments", lambda a: a.turn == i), lambda a: a.source)
    turns = F.transform("pieces", lambda p, i: F.struct(role(p).alias("role"), restored(body(p), sources(i)).alias("text")))
    masked = F.zip_with("pieces", "loss_runs", lambda p, r: F.substring(p, r.skip + 1, r.keep))
    learned = F.transform(masked, lambda p, i: F.when(p == "", "").otherwise(restored(p, sources(i))))
    return split.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"), "attachments")


#: A conversation of two turns that hold control strings, of this template and another.
CONTROLS = r"\### Assistant: </turn> ok"


def op12_chat(spark, sf_dir):
    """All conversations and one of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROLS).alias("text"))
    turns = rows.unionByName(more).withColumn("parts", parts_of(F.coalesce("text", F.lit(""))))
    back = read_chats(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars",
    )


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, '<turn ' || replace(replace(role, '&', '&amp;'), '>', '&gt;') || chr(62) || chr(10) AS head,
         regexp_replace(text, '<(\\*/?(?:turn|image|audio|document|part)\b)', '<\\\1', 'g') AS body
  FROM t
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, head || body) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, head || body) FILTER (role = 'assistant'), '') AS learned,
         sum(length(head) + length(body) + 8)::BIGINT AS formatted_chars
  FROM s GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM whole
"""
