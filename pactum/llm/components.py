"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link but the roots.

    ``links``: columns a, b (long). A small-star step hangs the smaller neighbours of a
    node on the smallest, which merges many links of one node into few; a large-star
    step does so for the larger ones. Both are group-wise minima (aggregated before
    the shuffle) followed by a join that may split a hot node. The edge table is written
    to shared storage each round and never held by the driver, which only asks
    whether a node still hangs on several others, or hangs and has nodes hang on it.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    for _ in range(rounds):
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.filter("u != v").distinct(), name)
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty():
            # Stars only; a root that hangs nowhere is its component's smallest node.
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(large.distinct(), name)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
