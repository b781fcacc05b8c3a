"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspan.llm.shared import WorkTables


def connected_components(edges: DataFrame, work: WorkTables, most_rounds: int = 40) -> DataFrame:
    """(node, component) of every node in `edges` (long columns u, v); a component is its smallest node.

    Each round is written to the shared folder in place of the one before. More than
    `most_rounds` rounds raise an error; their number grows with the logarithm of the longest
    chain of links. Every step sends, for a node, one row per
    neighbour, and a node's minimum is aggregated before the shuffle, so a node with
    very many neighbours costs what they cost.
    """
    edges = work.stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: neighbours larger than u point to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        read = work.paths[-1]
        edges = work.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        work.drop([read])
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
