"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Join the neighbours of each node to the least of them and itself: those above it (large), or those below it and itself (small)."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    # kept, so that the join has plain exchanges on both sides and a hub's edges can be split
    least = checkpointed(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    joined = near.join(least, "u")
    out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (x, y); component is the least node reachable.

    Each round is two joins on the node, pre-aggregated, and is kept in the checkpoint folder; the
    number of rounds grows with the logarithm of the longest path.  No edge reaches the driver.
    """
    edges = checkpointed(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u > v").distinct())
    mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    while mark[0]:
        edges = checkpointed(_stars(_stars(edges, True), False))
        new = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
