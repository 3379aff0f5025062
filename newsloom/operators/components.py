"""Connected components of a graph of links, by alternating large-star and small-star steps.

Both steps replace each node's links by links to the smallest node next to it, found with
a partial aggregation and an equi-join of written tables, which adaptive execution can split,
so a node with very many links is neither gathered nor joined in one task.
Each round is written to the shared folder, and the rounds end when no link changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.shared import stored


def large_star(links: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """links lead from the larger node a to b; links b, and a, to the smallest that a leads to."""
    least = stored(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def mark(links: DataFrame):
    """Count and a sum of hashes: alike if the links are."""
    return links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b; longs): root is the smallest node of its component."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stored(links, "links")
    seen = mark(links)
    while seen[0]:
        links = stored(small_star(stored(large_star(links), "links")), "links")
        now = mark(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
