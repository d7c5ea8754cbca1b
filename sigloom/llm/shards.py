"""Sharding by extendible hashing.

A directory is indexed by the first bits of a key's hash. Only buckets over the byte limit split, on one more bit,
until every shard fits. The directory is found from byte sums of hash cells, so the texts are read once and rows move
only when they are written.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import cut, neutral, stored

#: Hash bits of a key, from its md5.
BITS = 60
SHARD_BYTES = 1 << 20
#: Bits by which cells are finer than shards of even size would be.
FINER = 2
#: Cells of a directory that is broadcast, at most; one takes about 200 bytes in memory.
BROADCAST_CELLS = 1 << 14


def leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(g, depth, prefix, bytes, n): the buckets of each group after all splits, for cells (g, cell, bytes, n) of ``high`` bits.

    A bucket at a depth is final if it fits, or has ``high`` bits, and the one it came from doesn't fit.
    """
    depth = F.explode(F.sequence(F.lit(low), F.lit(high)))
    spread = cells.select("g", "cell", "bytes", "n", depth.alias("depth"))
    prefix = F.expr(f"shiftright(cell, {high} - depth)")
    nodes = spread.groupBy("g", "depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    nodes = cut(nodes)
    above = nodes.where(F.col("bytes") > limit).select("g", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    ends = nodes.where((F.col("bytes") <= limit) | (F.col("depth") == high)).withColumn("up", F.shiftright("prefix", 1))
    top = ends.where(F.col("depth") == low).select("g", "depth", "prefix", "bytes", "n")
    below = ends.where(F.col("depth") > low).join(above, ["g", "depth", "up"], "left_semi")
    return cut(top.unionAll(below.select("g", "depth", "prefix", "bytes", "n")))


def split_rows(rows: DataFrame, low: int, high: int, width: int, limit: int, mark: str, dense: bool) -> DataFrame:
    """``rows`` (g, bits, n_bytes, ...) with their bucket's name as ``shard`` and whether it is still ``over`` the limit.

    ``bits`` has ``width`` bits, of which the buckets use ``low`` to ``high``. ``dense``: each bucket is spelled out as
    all the cells it covers, at most 2^high a group; otherwise the cells that occur look their bucket up at each depth.
    """
    rows = rows.withColumn("cell", F.shiftright("bits", width - high))
    cells = rows.groupBy("g", "cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
    bits = F.expr("case when depth > 0 then lpad(bin(prefix), depth, '0') else '' end")
    name = F.concat("g", F.lit("/"), bits) if mark else bits
    over = ((F.col("bytes") > limit) & (F.col("n") > 1)).alias("over")
    ends = leaves(cells, low, high, limit).select("g", "depth", "prefix", name.alias("shard"), over)
    if dense:
        first = F.expr(f"shiftleft(prefix, {high} - depth)")
        last = F.expr(f"shiftleft(prefix + 1, {high} - depth) - 1")
        lookup = ends.select("g", F.explode(F.sequence(first, last)).alias("cell"), "shard", "over")
    else:
        depth = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        lookup = cells.select("g", "cell", depth).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        lookup = lookup.join(ends, ["g", "depth", "prefix"]).select("g", "cell", "shard", "over")
    lookup = cut(lookup)
    small = lookup.count() <= BROADCAST_CELLS
    return cut(rows.join(F.broadcast(lookup) if small else lookup, ["g", "cell"]).drop("cell"))


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES, row: str | None = None) -> DataFrame:
    """key, the column ``row`` if named, n_bytes, shard (its hash bits as text) and depth (their number) of every row.

    A null key hashes as the empty text; a null text has no bytes; an empty table gives an empty result. Rows with the
    same key share all hash bits, so where they alone exceed the limit, bits from the rows' places follow after a slash.
    Only a single row larger than the limit makes a shard over it.
    """
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    number = F.col(row) if row else F.lit(0)
    rest = cut(docs.select(F.col(key).alias("key"), number.alias("row"), F.lit("").alias("g"), hashed.alias("bits"), size.alias("n_bytes")))
    finer = lambda most: FINER + max(0, math.ceil(math.log2(max(1, (most or 0) / limit))))
    high = min(BITS, finer(rest.agg(F.sum("n_bytes")).first()[0]))
    rounds = [split_rows(rest, 0, high, BITS, limit, "", True)]
    if high < BITS and not (rest := rounds[-1].where("over")).isEmpty():
        rest = rest.select("key", "row", F.lit("").alias("g"), "bits", "n_bytes")
        rounds.append(split_rows(rest, high, BITS, BITS, limit, "", False))
    while not (rest := rounds[-1].where("over")).isEmpty():
        most = rest.groupBy("shard").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0]
        place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.lit(len(rounds))), 34)
        rest = cut(rest.select("key", "row", F.col("shard").alias("g"), place.alias("bits"), "n_bytes"))
        rounds.append(split_rows(rest, 0, min(30, finer(most)), 30, limit, "/", True))
    out = None
    for found in rounds:
        part = found.where("not over").select("key", "row", "n_bytes", "shard")
        out = part if out is None else out.unionAll(part)
    return out.select(F.col("key").alias(key), *([F.col("row").alias(row)] if row else []), "n_bytes", "shard", F.length(F.replace("shard", F.lit("/"), F.lit(""))).alias("depth"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """One folder of Parquet per shard under ``path``, which holds every row of ``docs`` once, those with the same key as well.

    Rows are numbered in a table in the shared folder, since rows with the same key may go to different shards.
    """
    if any(c.lower() == "shard" for c in docs.columns):
        raise ValueError("the folders are named by a column shard; rename the one that the rows have")
    plain, name, _ = neutral(docs)
    rows = stored(plain.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    where = assign_shards(rows, name[key], name[text], limit, "__row").select("__row", "shard")
    joined = rows.join(where, "__row").select(*(F.col(name[c]).alias(c) for c in docs.columns), "shard")
    joined.repartition("shard").write.partitionBy("shard").parquet(path)


def op5_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs)


OP5_SQL = f"""
WITH RECURSIVE rows AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS h FROM documents),
levels AS (SELECT unnest(range(0, 25)) AS depth),
nodes AS (SELECT depth, h >> ({BITS} - depth) AS prefix, sum(n_bytes) AS bytes, count(*) AS n FROM rows, levels GROUP BY 1, 2),
fits AS (SELECT depth, prefix FROM nodes WHERE bytes <= {SHARD_BYTES} OR n = 1),
best AS (SELECT r.doc_id, r.n_bytes, r.h, min(f.depth) AS depth FROM rows r JOIN fits f ON f.prefix = r.h >> ({BITS} - f.depth) GROUP BY 1, 2, 3)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h >> ({BITS} - depth)), 64, '0'), CAST(depth AS INTEGER)) END AS shard, CAST(depth AS INTEGER) AS depth FROM best
"""
