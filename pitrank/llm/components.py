"""Connected components of links between 64-bit nodes, as repeated joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them. Links point down (a > b)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link.

    ``links`` has columns a and b, in any direction, repeats and self-links allowed. Large-star and small-star steps
    alternate; every step is aggregations with partial sums and equality joins, and its links go to the shared folder,
    so that a lost executor costs one step. The number of rounds grows with the logarithm of the longest chain.
    """
    down = (links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    links, mark = materialize(down), None
    while True:
        links = materialize(_small_star(_large_star(links)))
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b"), F.col("b")).distinct())
        mark = now
