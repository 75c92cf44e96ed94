"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweight.llm.shared import saved


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("node"), one.alias("up"), none.alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), none.alias("up"), one.alias("down"))
    )
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes of the undirected ``edges (a, b)``; the component is the
    smallest node that can be reached.

    Alternating large-star and small-star steps: every node hands its larger, then its smaller
    neighbours over to the smallest node it knows, until only stars are left. Minima are combined
    before the shuffle, so a node with very many edges costs one row for each task; the joins
    stand alone before the next shuffle, so that Spark can split such a node's edges. Each round
    is written to the shared folder, which cuts the lineage.
    """
    pairs = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    pairs = pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = saved(pairs, "edges")
    while not _stars(current):
        # Large star: of every node's neighbours, the larger ones go to the smallest node around it.
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b")
        # Small star: the smaller neighbours, and the node itself, go to the smallest of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        current = saved(small.filter("a <> b").distinct(), "edges")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
