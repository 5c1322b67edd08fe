"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each step
replaces the edges by at most as many others; after a few rounds every node is
linked to the smallest of its component. Only whether that is so reaches the
driver, and each round's edges are a table in the shared folder, so that a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.rows import narrow
from siltstone.scratch import remove, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down and no node is both an end and a centre: then all is done."""
    ends = edges.groupBy("a").agg(F.count("*").alias("down"))
    centres = edges.select(F.col("b").alias("a"), F.lit(1).alias("is_centre")).distinct()
    return ends.join(centres, "a", "left").filter("down > 1 OR is_centre IS NOT NULL").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (columns a, b; any order, loops allowed).

    component is the smallest node reachable.
    """
    now = written(narrow(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
    while not _are_stars(now):
        after = written(narrow(_small(_large(now))), "edges")
        remove(now)
        now = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
