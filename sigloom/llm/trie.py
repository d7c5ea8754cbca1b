"""A prefix trie of conversations, kept as rows.

Each conversation owns a suffix of its path: the nodes whose smallest member it is. So a node is a pair of owner and
depth, and what its subtree saves is what the turns of its members weigh from that depth on, less what they own there.
Both are prefix sums along a conversation, and one aggregation by prefix adds them up; no node meets its subtree.

A prefix is known by the running xor of two 64-bit hashes of (depth, role, text). Conversations are dealt by ranges of
their rows, so that ranks, hashes and sums run over parts of a long conversation and are carried from part to part.
Smallest members come from a grouped minimum, which is combined before the shuffle: a window over a prefix that a third of
all conversations share would put them into one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import ship_package, stored, table

#: Members of a node that end there are put together in chunks of at most 2**CHUNK_BITS of neighbouring conversations.
CHUNK_BITS = 12
#: Parents that more than 1 in HOT of all conversations look up are broadcast; there are HOT of them at most.
HOT = 1000
NODE = ["depth", "p1", "p2"]


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, part, rank, a, b, weight): the turns of each conversation in order, numbered from 1, with two hashes and the bytes of the text.

    Turns are ordered by ``turn`` (null first), ties by role and text; null roles and texts are empty. Rows without a
    conversation's id belong to none and are left out. A long conversation lies in several parts.
    """
    named = conversations.select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")
    ).where("c is not null")
    order = [F.col("c"), F.asc_nulls_first("t"), F.col("r"), F.col("x")]
    placed = named.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "c", F.monotonically_increasing_id().alias("place"), F.xxhash64("r", "x").alias("a"), F.xxhash64(F.lit(1), "x", "r").alias("b"),
        F.octet_length("x").cast("long").alias("weight"),
    )
    placed = stored(placed, "turns").withColumn("part", F.shiftright("place", 33).cast("int"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("c", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    parts = parts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = placed.join(parts, ["c", "part"]).select("c", "part", (F.col("place") - F.col("first") + F.col("off") + 1).alias("rank"), "a", "b", "weight")
    return stored(ranked, "ranked-turns")


def with_borrowed_heads(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt paths (c, part, depth, a, b, weight), and (c, length) of every conversation, those without turns too.

    The first h turns come from conversation c - c % group (all if it has fewer, none if there is none), then c's own turns
    after its first h; h = crc32(decimal c) % most.
    """
    convs = turns.groupBy("c").agg(F.count("*").alias("n")).withColumn("base", F.col("c") - F.col("c") % group)
    convs = convs.withColumn("h", F.when(F.col("base") == F.col("c"), 0).otherwise(F.crc32(F.encode(F.col("c").cast("string"), "UTF-8")) % most))
    bases = convs.where("base = c").select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stored(convs.select("c", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    parts = turns.select("c", "part").distinct().join(convs, "c").select("c", "part", "h", "k")
    own = turns.join(parts, ["c", "part"]).where("rank > h").select("c", "part", (F.col("rank") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "weight")
    heads = turns.where((F.col("rank") < most) & (F.col("c") % group == 0)).withColumnRenamed("c", "base")
    heads = heads.join(convs.where("k > 0").select("c", "base", "k"), "base").where("rank <= k")
    heads = heads.select("c", F.lit(-1).alias("part"), F.col("rank").alias("depth"), "a", "b", "weight")
    return own.unionAll(heads), convs.select("c", "length")


def occurrences(paths: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes on each path, the root included, and (c, part, total): the parts of each path and its whole weight.

    Nodes: c, part, depth, prefix p1 and p2, that of the parent q1 and q2, the weight of the turns before this one, and on
    the last turn a chunk number, which ascends with c.
    """
    x1, x2 = F.xxhash64("depth", "a", "b"), F.xxhash64("b", "depth", "a")
    here = Window.partitionBy("c", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = paths.select("c", "part", "depth", "weight", x1.alias("x1"), x2.alias("x2"))
    local = local.select("*", F.bit_xor("x1").over(here).alias("l1"), F.bit_xor("x2").over(here).alias("l2"), F.sum("weight").over(here).alias("sum"))
    local = stored(local, "paths")
    ends = local.groupBy("c", "part").agg(F.bit_xor("x1").alias("e1"), F.bit_xor("x2").alias("e2"), F.sum("weight").alias("e"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda f, x: F.coalesce(f(x).over(before), F.lit(0))
    carried = ends.select(
        "c", "part", carry(F.bit_xor, "e1").alias("c1"), carry(F.bit_xor, "e2").alias("c2"), carry(F.sum, "e").alias("base"),
        F.sum("e").over(Window.partitionBy("c")).alias("total"),
    )
    carried = stored(carried, "carried")
    placed = lengths.repartitionByRange("c").sortWithinPartitions("c").withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS))
    placed = stored(placed, "lengths")
    in_parts = carried.join(placed, "c")
    p1, p2 = F.col("l1").bitwiseXOR(F.col("c1")), F.col("l2").bitwiseXOR(F.col("c2"))
    nodes = local.join(in_parts, ["c", "part"]).select(
        "c", "part", "depth", p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("x1")).alias("q1"), p2.bitwiseXOR(F.col("x2")).alias("q2"),
        (F.col("base") + F.col("sum") - F.col("weight")).alias("before"), F.when(F.col("depth") == F.col("length"), F.col("chunk")).alias("chunk"),
    )
    zero = lambda n: F.lit(0).cast("long").alias(n)
    roots = placed.select("c", F.lit(-2).alias("part"), zero("depth"), *map(zero, ("p1", "p2", "q1", "q2", "before")), F.when(F.col("length") == 0, F.col("chunk")).alias("chunk"))
    tops = placed.join(carried.groupBy("c").agg(F.first("total").alias("total")), "c", "left").select("c", F.lit(-2).alias("part"), F.coalesce("total", F.lit(0)).alias("total"))
    return stored(nodes.unionAll(roots), "nodes-on-paths"), carried.select("c", "part", "total").unionAll(tops)


def end_digests(nodes: DataFrame) -> DataFrame:
    """depth, p1, p2 and the digest of the ids, ascending and comma-joined, of the members that end there.

    Chunks of ids are put together by Spark; a task then feeds a node's chunks one after the other into one digest, so
    neither rows nor memory of a task grow with a node's members as ids do.
    """
    chunks = nodes.where("chunk is not null").groupBy(*NODE, "chunk").agg(F.sort_array(F.collect_list("c")).alias("ids"))
    chunks = chunks.select(*NODE, "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ship_package(nodes.sparkSession)

    def run(batches):
        key, digest = None, None

        def row():
            return pa.RecordBatch.from_pydict(
                {"depth": pa.array([key[0]], pa.int64()), "p1": pa.array([key[1]], pa.int64()), "p2": pa.array([key[2]], pa.int64()), "ends": pa.array([digest.hexdigest()])}
            )

        for batch in batches:
            done = []
            for *now, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids"))):
                if now != key:
                    if key is not None:
                        done.append(row())
                    key, digest = now, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if key is not None:
            yield row()

    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").drop("chunk").mapInArrow(run, "depth long, p1 long, p2 long, ends string")


def prefix_trie(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the paths (c, part, depth, a, b, weight), the empty one included; see the module.

    ``lengths`` has (c, length) of every conversation, without turns too. Depths of a path run from 1 without gaps, and
    ascend with its parts. No conversation, no node.
    """
    nodes, parts = occurrences(paths, lengths)
    owned = nodes.groupBy(*NODE).agg(F.min("c").alias("c"), F.bool_and(F.col("chunk").isNotNull()).alias("leaf"), F.min("before").alias("before"))
    owned = owned.groupBy("c").agg(F.min("depth").alias("from"), F.min("before").alias("free"), F.bool_or("leaf").alias("leaf"))
    marks = parts.join(owned, "c", "left").select("c", "part", "from", F.coalesce("free", "total").alias("free"), F.coalesce("leaf", F.lit(False)).alias("leaf"))
    marked = nodes.join(marks, ["c", "part"])
    told = marked.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if((F.col("from") <= F.col("depth") + 1) & F.col("chunk").isNull()).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("free") - F.col("before"), F.lit(0))).alias("saved_tokens"),
        F.bool_or(F.col("from") == F.col("depth")).alias("topmost"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
    )
    told = stored(told, "trie")
    # Only the topmost node that a conversation owns has another's node for a parent.
    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    ask = told.where("topmost and depth > 0").select(*up, F.col("conv_id").alias("child"))
    answer = told.select(*NODE, F.col("conv_id").alias("parent_conv_id"), ((F.col("n_children") - 1) * HOT > lengths.count()).alias("hot"))
    hot = F.broadcast(answer.where("hot").drop("hot"))
    parents = ask.join(hot, NODE).unionByName(ask.join(hot, NODE, "left_anti").join(answer.where("not hot").drop("hot"), NODE))
    parents = parents.select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent_conv_id")
    whole = told.join(parents, ["conv_id", "depth"], "left").join(end_digests(nodes), NODE, "left")
    own_parent = F.when((F.col("depth") > 0) & ~F.col("topmost"), F.col("conv_id"))
    return whole.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", own_parent).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_trie(spark, sf_dir):
    return prefix_trie(*with_borrowed_heads(ordered_turns(table(spark, sf_dir, "conversations"))))


#: Prefixes as text, each node's subtree by the paths that pass through both; the checksum bit by bit.
OP11_SQL = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT c, c - c % 5 AS base, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda s:
    [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
), rebuilt AS (
  SELECT k.c, t.i, 0 AS own, t.r, t.x FROM k JOIN t ON t.c = k.base AND t.i <= k.h
  UNION ALL
  SELECT k.c, t.i, 1, t.r, t.x FROM k JOIN t ON t.c = k.c AND t.i > k.h
), d AS (
  SELECT c, row_number() OVER w AS depth, strlen(x) AS bytes,
         string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY own, i ROWS UNBOUNDED PRECEDING) AS p
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, i)
), o AS (
  SELECT c, depth, bytes, p FROM d UNION ALL SELECT c, 0, 0, '' FROM k
), longest AS (SELECT c, max(depth) AS length FROM o GROUP BY c
), node AS (
  SELECT depth, p, min(o.c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, max(length) = depth AS childless,
         sha256(coalesce(string_agg(o.c::VARCHAR, ',' ORDER BY o.c) FILTER (length = depth), '')) AS ends_sha256
  FROM o JOIN longest USING (c) GROUP BY depth, p
), below AS (
  SELECT DISTINCT u.depth, u.p, v.depth AS d2, v.p AS p2 FROM o u JOIN o v ON u.c = v.c AND v.depth >= u.depth
), sums AS (
  SELECT b.depth, b.p, count(*) FILTER (d2 = b.depth + 1) AS n_children, count(*) FILTER (n.childless) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
  FROM below b JOIN node n ON n.depth = d2 AND n.p = p2 GROUP BY b.depth, b.p
)
SELECT node.conv_id, node.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs, n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN sums ON sums.depth = node.depth AND sums.p = node.p
LEFT JOIN (SELECT DISTINCT d2, p2, b.depth, b.p FROM below b WHERE d2 = b.depth + 1) e ON e.d2 = node.depth AND e.p2 = node.p
LEFT JOIN node up ON up.depth = e.depth AND up.p = e.p
"""
