"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Alternates large-star and small-star steps: each hooks neighbours to the smallest node seen, found by a
    partially aggregated minimum, until the edges are stars. Rounds grow as the logarithm of the longest chain.
    Each round is cut by a checkpoint. Nulls and loops are left out; an empty table gives an empty result.
    """
    x, y = F.col(a), F.col(b)
    now = edges.select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).where("v is not null and u <> v")
    now = cut(now.distinct())
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select("v", F.col("m").alias("u")).where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        rest = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = cut(low.select("v", F.col("m").alias("u")).unionAll(rest).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(roots)
