"""Sinks of a stream that a batch may reach twice, a graph kept up by what each batch adds, and mergeable quantile counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.sources.snapshots import SnapshotTable
from veldgraph.storage import stored

#: Leading bits of a value that its bucket keeps: the lower edge is less than 1 / 128 of the value below it.
BITS = 8


def append_once(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch is a folder of its number, so a batch that is run again replaces itself."""

    def use(df: DataFrame, batch: int) -> None:
        prepare(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return use


class GraphUpkeep:
    """Nodes (node_id, label), edges (src, dst, rel_type, weight) and counts (kind, name, n) as tables with a version a batch.

    A batch is merged into the version before it, whenever and how often it is run. Only
    buckets that the batch touches are rewritten, and counts grow by what was new.
    """

    def __init__(self, spark, path: str, buckets: int = 16):  # noqa: ANN001
        self.nodes = SnapshotTable(spark, f"{path}/nodes", ["node_id"], buckets)
        self.edges = SnapshotTable(spark, f"{path}/edges", ["src", "dst", "rel_type"], buckets)
        self.counts = SnapshotTable(spark, f"{path}/counts", ["kind", "name"], 1)

    def apply(self, nodes: DataFrame, edges: DataFrame, batch: int) -> None:
        """Adds a batch, numbered from 0 without gaps. Of several labels of a node the first counts, in a batch the least."""
        version = batch + 1
        if version in self.counts.versions():
            return
        nodes = stored(nodes.filter("node_id is not null").groupBy("node_id").agg(F.min("label").alias("label")), "nodes")
        edges = stored(edges.filter("src is not null and dst is not null").groupBy("src", "dst", "rel_type").agg(F.count("*").alias("weight")), "edges")
        fresh = lambda table, rows: rows.join(table.read(batch).select(*table.key), table.key, "left_anti") if batch else rows
        new = fresh(self.nodes, nodes).groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
        new = new.unionByName(fresh(self.edges, edges).groupBy(F.lit("edge").alias("kind"), F.col("rel_type").alias("name")).agg(F.count("*").alias("n")))
        new = stored(new, "counts")
        self.nodes.merge(nodes, lambda old, more: old.unionByName(more.join(old.select("node_id"), "node_id", "left_anti")), version)
        self.edges.merge(edges, _summed(["src", "dst", "rel_type"], "weight"), version)
        # The counts come last: a batch that stopped before them is done again, and merges that are there stay.
        self.counts.merge(new, _summed(["kind", "name"], "n"), version)


def _summed(key: list[str], value: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda old, new: old.unionByName(new).groupBy(*key).agg(F.sum(value).alias(value))


def bucket_edge(value: Column) -> Column:
    """The lower edge of a long's bucket: its first ``BITS`` bits, the others zero. Negative values are mirrored."""
    size = F.length(F.bin(F.abs(value)))
    shift = F.greatest(F.lit(0), size - BITS)
    edge = F.call_function("shiftleft", F.call_function("shiftright", F.abs(value), shift), shift)
    return F.when(value < 0, -edge).otherwise(edge)


def sketched(rows: DataFrame, group: list[str], value: Column) -> DataFrame:
    """(group, edge, n): counts by bucket, on a batch or as the state of a stream. Sketches of parts merge by adding, so how rows are split doesn't matter."""
    return rows.filter(value.isNotNull()).groupBy(*group, bucket_edge(value).alias("edge")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, group: list[str], shares: dict[str, float]) -> DataFrame:
    """The edge of the bucket that holds the element at floor(n * share): its rank is exact, its value at most 1 / 128 too low. A group has a few thousand buckets at most."""
    counts = sketch.groupBy(*group, "edge").agg(F.sum("n").alias("n"))
    placed = counts.withColumns({"end": F.sum("n").over(Window.partitionBy(*group).orderBy("edge")), "all": F.sum("n").over(Window.partitionBy(*group))})
    at = lambda share: F.least(F.floor(F.col("all") * F.lit(share)), F.col("all") - 1)
    return placed.groupBy(*group).agg(F.max("all").alias("n"), *[F.min(F.when(F.col("end") > at(s), F.col("edge"))).alias(name) for name, s in shares.items()])
