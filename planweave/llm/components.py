"""Connected components of a graph too large for one machine, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import pinned

#: Links in a part of the table that is held between rounds, about.
PART = 50_000


def _measure(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for all ends of links (a, b).

    A large star ties every greater neighbour of a node to the least one it knows: a minimum for each node, combined before the shuffle, and
    a join that Spark can split where a node has many links. A small star then ties the lesser neighbours of a node, few by now, to the
    least. When a round changes nothing, every node hangs on the least of its component; that is so after a number of rounds which grows with
    the logarithm of the nodes.
    """
    edges = pinned(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = _measure(edges)
    while True:
        parts = max(1, seen[0] // PART)
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        tied = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b")
        edges = pinned(tied.distinct().coalesce(parts))
        now = _measure(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
