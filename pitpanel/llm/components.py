"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.session import cut_lineage


def connected(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node reachable.

    Each round links every neighbour above a node to the smallest node around it, then every
    node to the smallest below it; minima are aggregates and the rest is a join, so a node with
    very many edges needs no task of its own. Rounds end when nothing changes; their number grows
    with the logarithm of the graph. Eager: a table on the shared folder for each round.
    """
    e = cut_lineage(edges.filter(F.col(first) != F.col(second)).select(
        F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u")
        e = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
                        .unionByName(below.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
