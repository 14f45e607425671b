"""Connected components over a table of links between 64-bit nodes, by alternating large and small stars.

Labels and links stay in tables; the driver sees two numbers a round. Groups are only ever aggregated (partial sums on
the map side) or joined, so a node with a third of all links is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("low"))
    moved = e.join(low, "u").filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v")))


def roots(links: DataFrame, name: str = "stars") -> DataFrame:
    """(u, v) links to (node, root): root is the smallest node that node reaches; only nodes with links, roots left out."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    before = last = None
    while True:
        edges = scratch.stored(edges, name)
        if last is not None:
            scratch.forget(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, last = now, edges
        edges = _small(_large(edges).distinct()).distinct()
