"""Connected components by alternating large stars and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: u, v (long). Returns node, root for every node that has an edge; root is the smallest node reachable.

    Each half round takes the smallest neighbour of every node, an aggregation with partial minima, and joins it
    back; no list of neighbours is ever gathered. Ends when a round changes nothing.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = None
    for _ in range(rounds):
        most = 2 * now.count() * 16  # a half round makes at most two edges of one, of two numbers each
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour points to the smallest one
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large", most)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: smaller neighbours and the node itself point to the smallest one
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "small", 2 * most)
        drop(large)
        was, print_of = print_of, after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = after
        if was == print_of:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
