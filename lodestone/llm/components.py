"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Rows (node, root): each node that has an edge, and the smallest node that it reaches.

    In a round every node first hangs its larger neighbours on the smallest node around it, then its smaller
    neighbours and itself. Both are one minimum for each node (summed up before the shuffle) and one join with
    the minima, written out first so that Spark can split a node with very many edges. The number of rounds grows with the logarithm of the longest path. Loops and repeated edges do no harm; nulls are dropped.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = cut(e)
    before = None
    for _ in range(rounds):
        # large star: all neighbours larger than u move to the smallest around u, which is u itself for most
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"))
        large = both.where("v > u").join(least, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
        large = cut(large.distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
