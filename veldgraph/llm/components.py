"""Connected components of an undirected edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldgraph.llm.skew import split_join
from veldgraph.storage import stored


def _least(edges: DataFrame) -> DataFrame:
    """u, its least neighbour m and its number of neighbours. A star's centre has many, so what is joined on ``u`` is split by them."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node moves to the least of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("u", "m"))
    return split_join(both.filter("v > u"), least, ["u"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours move to the least of them. Edges have u > v."""
    least = _least(edges)
    moved = split_join(edges, least, ["u"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a lesser one at most, and none if a greater one has an edge to it."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    counts = ends.groupBy("id").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    return counts.filter("down > 1 or (down > 0 and up > 0)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes with an edge; component is the least id reachable.

    ``edges`` has long columns a and b. Loops and rows with a null are no edges.
    Each round is written to the shared folder; the number of rounds grows with the
    logarithm of the longest path. Edges that are stars around least nodes are the
    components, which one count of ends tells, so no round is spent on finding no change.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(now.distinct(), "edges")
    while not _stars(now):
        now = stored(_small_star(stored(_large_star(now), "stars")), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
