"""Deletes that cascade at any depth and spare what other nodes still refer to.

Edges are written once, as a table in buckets of their source, so the walks join each
frontier with the buckets where they lie and shuffle the ids of nodes, not the edges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldgraph.operators.joins import union_all
from veldgraph.storage import scratch_path, stored

#: Frontiers up to this number of ids go to where the edges are; larger ones are shuffled.
SENT = 100_000
#: After so many steps the parts of what is reached become one table, so plans stay short at any depth.
FOLD = 16


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df``, in as many parts by ``key`` as a shuffle has, as a table in as many buckets, one sorted file each; two such tables join without a shuffle."""
    spark = df.sparkSession
    name = f"veldgraph_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key)
    writer.option("path", scratch_path(spark, "buckets")).saveAsTable(name)
    return spark.table(name)


def by_source(edges: DataFrame) -> DataFrame:
    """The edges in buckets of ``src``; this is the only shuffle of all of them."""
    return _bucketed(edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src"), "src")


def reached(edges: DataFrame, start: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(node_id) of ``start`` and all that its nodes reach along edges, to the fixpoint; with ``within`` only through and to its nodes.

    Each step is stored, carries each node once, and joins only what the step before added.
    """
    front = _bucketed(start.select("node_id").filter("node_id is not null").distinct(), "node_id")
    found, step = [front], 0
    while n := front.count():
        step += 1
        ids = front.withColumnRenamed("node_id", "src")
        new = edges.select("src", "dst").join(F.broadcast(ids) if n <= SENT else ids, "src", "left_semi").select(F.col("dst").alias("node_id")).distinct()
        for nodes in found:
            new = new.join(nodes, "node_id", "left_anti")
        if within is not None:
            new = new.join(within, "node_id", "left_semi")
        front = _bucketed(new, "node_id")
        found.append(front)
        if step % FOLD == 0:
            found = [_bucketed(union_all(found), "node_id")]
    return union_all(found)


def doomed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node_id) of the roots and of what only they, and what goes with them, refer to.

    What the roots reach stays if a node outside refers to it, and so does what that one
    reaches without a root. A root goes whoever refers to it. Cycles go as a whole if
    nothing outside holds them.
    """
    return _doomed(by_source(edges.select("src", "dst").filter("src is not null and dst is not null")), roots)


def _doomed(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The same for edges in buckets."""
    links = links.filter("src is not null and dst is not null")
    roots = _bucketed(roots.select("node_id").filter("node_id is not null").distinct(), "node_id")
    below = _bucketed(reached(links, roots), "node_id")
    inner = below.join(roots, "node_id", "left_anti")
    # Edges leave by their source first, where they lie; of the others only the ends are shuffled.
    outside = links.join(below.withColumnRenamed("node_id", "src"), "src", "left_anti").select(F.col("dst").alias("node_id")).distinct()
    held = reached(links, outside.join(inner, "node_id", "left_semi"), within=inner)
    return below.join(held, "node_id", "left_anti")


def deleted(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the cascade; edges at a deleted node go with it.

    What goes without being a root has no edge from a source that stays, else that source
    would hold it. So edges go by their source, and by their end only if it is a root or
    they have no source.
    """
    links = by_source(edges)
    gone = _bucketed(_doomed(links, roots), "node_id")
    ends = stored(roots.select(F.col("node_id").alias("dst")).filter("dst is not null").distinct(), "roots")
    kept = links.filter("src is not null").join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti").join(ends, "dst", "left_anti")
    loose = links.filter("src is null").join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), kept.select(*edges.columns).unionByName(loose.select(*edges.columns))
