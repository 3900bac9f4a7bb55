"""An inverted-list index of vectors: a coarse quantiser, lists as a partitioned table, and searches that open only the lists they probe.

The quantiser is fitted on at most ``SAMPLE`` vectors, those of the least id hashes; every row
is in a list. A list is a folder of the table, so a search reads the probed ones only.
``probed`` is approximate: its recall grows with ``probes``, by default as many lists as the
sample's own neighbours need for a recall of ``RECALL``: two or three where rows lie in
clusters, half of all lists where they lie evenly in many dimensions. ``exact`` then opens what could
still hold a better row: with the widest angle r of a list's rows to its centre c, no row is
closer to a query q than the angle (q, c) - r.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.operators import vector
from veldgraph.storage import stored

#: The most vectors that the quantiser sees, and its rounds.
SAMPLE = 20_000
ROUNDS = 12
#: The recall that ``probes`` aims at, in the sample, of so many neighbours of so many of its rows.
RECALL, NEIGHBOURS, TRIED = 0.95, 10, 256
#: Rows and queries of a list that meet in one task.
BLOCK = 8192
#: Angles are widened by so much against rounding, so ``exact`` may open a list too many but none too few.
SLACK = 1e-6

CENTRES = "list int, centre array<double>, angle double, size long, probes int"


@dataclass(frozen=True)
class Index:
    """Where the lists are, the centres (lists x dim) with the widest angle and the size of each list, and how many lists to probe."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    angles: np.ndarray
    sizes: np.ndarray
    probes: int

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """The rows (id, v, list) of some lists; the others' folders are not opened."""
        df = self.spark.read.schema("id long, v array<double>, list int").parquet(f"{self.path}/lists")
        return df if lists is None else df.filter(F.col("list").isin(lists))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of length one: k-means by cosine, begun with rows far apart, the same for the same sample."""
    unit = _unit(sample)
    chosen, far = [0], unit @ unit[0]
    while len(chosen) < min(lists, len(unit)):
        chosen.append(int(np.argmin(far)))
        far = np.maximum(far, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(rounds):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _needed(sample: np.ndarray, centres: np.ndarray) -> int:
    """The least number of nearest lists that hold ``RECALL`` of the neighbours of some rows of the sample."""
    unit = _unit(sample)
    own = np.argmax(unit @ centres.T, axis=1)
    near = np.argsort(-(unit[:TRIED] @ unit.T), axis=1, kind="stable")[:, : NEIGHBOURS + 1]
    order = np.argsort(-(unit[:TRIED] @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], axis=1), RECALL, method="higher")) + 1


def _whole(df: DataFrame, id_col: str, column: str) -> DataFrame:
    known = df.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    return known.filter("id is not null").filter(F.forall("v", lambda x: x.isNotNull()))


def written(vectors: DataFrame, path: str, lists: int = 64, id_col: str = "vec_id", column: str = "embedding", sample: int = SAMPLE) -> Index:
    """Writes the index. Vectors of the sample's first length are indexed; null vectors and those that hold a null are left out, as in an exact search.

    Rows are range-partitioned by list and id, so a list of any size is several files and a task writes few lists.
    """
    spark = vectors.sparkSession
    known = _whole(vectors, id_col, column)
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    dim = len(picked.iloc[0]) if len(picked) else 0
    rows = np.array([v for v in picked if len(v) == dim], float).reshape(-1, max(dim, 1))
    centres = fitted(rows, lists) if len(rows) else np.zeros((1, max(dim, 1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                cosines = unit @ centres.T
                own = np.argmax(cosines, axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(own)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array(angle)], names=["id", "v", "list", "angle"])

    placed = stored(known.filter(F.size("v") == dim).mapInArrow(assign, "id long, v array<double>, list int, angle double"), "placed")
    placed.drop("angle").repartitionByRange("list", "id").write.partitionBy("list").parquet(f"{path}/lists")
    angles, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("list").agg(F.max("angle").alias("angle"), F.count("*").alias("size")).collect():  # one row a list
        angles[r["list"]], sizes[r["list"]] = r["angle"], r["size"]
    probes = _needed(rows, centres) if len(rows) else 1
    described = [(i, c.tolist(), float(angles[i]), int(sizes[i]), probes) for i, c in enumerate(centres)]
    spark.createDataFrame(described, CENTRES).coalesce(1).write.parquet(f"{path}/centres")
    return Index(spark, path, centres, angles, sizes, probes)


def opened(spark: SparkSession, path: str) -> Index:
    """An index that was written before."""
    rows = sorted(spark.read.schema(CENTRES).parquet(f"{path}/centres").collect())  # one row a list
    return Index(spark, path, np.array([r["centre"] for r in rows], float), np.array([r["angle"] for r in rows]), np.array([r["size"] for r in rows]), rows[0]["probes"])


def _chosen(index: Index, queries: DataFrame, probes: int, least: bool) -> DataFrame:
    """(id, v, list) of each query and each list to open: the ``probes`` nearest that hold rows, or with ``least`` the others that may hold a row closer than the query's ``least`` cosine."""
    centres, angles, filled = index.centres, index.angles, index.sizes > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cosines = np.where(filled, np.clip(_unit(v) @ centres.T, -1, 1), -2)
                nearest = np.zeros(cosines.shape, bool)
                np.put_along_axis(nearest, np.argsort(-cosines, axis=1, kind="stable")[:, :probes], True, axis=1)
                if least:
                    bound = np.cos(np.maximum(0, np.arccos(np.clip(cosines, -1, 1)) - angles - SLACK))
                    # A zero vector has cosine 0 with everything and may be in any list.
                    possible = np.maximum(bound, 0) >= batch.column("least").to_numpy(zero_copy_only=False)[:, None] - SLACK
                    nearest = possible & ~nearest
                q, own = np.nonzero(nearest & filled)
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(own.astype(np.int32))], names=["id", "v", "list"])

    return queries.mapInArrow(run, "id long, v array<double>, list int")


def _searched(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the best k of each block of each list that a query opens."""
    asked = stored(asked, "asked")
    counts = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    if not counts:
        return asked.sparkSession.createDataFrame([], "query_id long, id long, score double")
    ceil = lambda n: max(1, -(-int(n) // BLOCK))
    splits = asked.sparkSession.createDataFrame([(i, ceil(n), ceil(index.sizes[i])) for i, n in counts.items()], "list int, query_blocks int, row_blocks int")
    dealt = lambda df, own, other: (
        df.join(F.broadcast(splits), "list").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).select("list", "query_block", "row_block", "id", "v")
    )
    keys = ("list", "query_block", "row_block")
    queries, rows = dealt(asked, "query_block", "row_block").groupBy(*keys), dealt(index.rows(sorted(counts)), "row_block", "query_block").groupBy(*keys)
    return queries.cogroup(rows).applyInArrow(vector._best(k), "query_id long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _asked(index: Index, queries: DataFrame, id_col: str, column: str) -> DataFrame:
    return _whole(queries, id_col, column).filter(F.size("v") == index.centres.shape[1])


def probed(index: Index, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k most similar rows of each query in its ``probes`` nearest lists."""
    probes = probes or index.probes
    found = _searched(index, _chosen(index, _asked(index, queries, id_col, column), probes, least=False), k)
    return _ranked(found, k).withColumn("score", F.round("score", 6))


def exact(index: Index, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The same over all rows: what is probed gives each query's k-th score, and lists that can't hold a better one stay closed."""
    probes = probes or index.probes
    asked = _asked(index, queries, id_col, column)
    first = stored(_ranked(_searched(index, _chosen(index, asked, probes, least=False), k), k), "probed")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1.0).alias("least"))
    rest = asked.join(kth.withColumnRenamed("query_id", "id"), "id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
    found = first.drop("rank").unionByName(_searched(index, _chosen(index, rest, probes, least=True), k))
    return _ranked(found, k).withColumn("score", F.round("score", 6))
