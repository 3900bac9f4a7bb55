"""Exact vector search, fusion of ranked lists and reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
#: Scores of matrix products that agree in so many places are ties; the order of their sums depends on the block.
TIES = 12


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null if the lengths differ."""
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero; null if the lengths differ."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / n))


def stand_in(text: Column, dim: int = 1536) -> Column:
    """A vector of numbers from -1 to 1 by digests of the text and the place: equal texts have equal vectors, on any machine. A text is digested once and its places from there on. A null text has nulls."""
    places = [str(i).encode() for i in range(dim)]

    def vector(t: str | None) -> list[None] | np.ndarray:
        if t is None:
            return [None] * dim
        start, digests = hashlib.md5(t.encode() + b":", usedforsecurity=False), []
        for place in places:
            one = start.copy()
            one.update(place)
            digests.append(one.digest()[:4])
        return (np.frombuffer(b"".join(digests), ">u4").astype(np.int64) - 2147483648) / 2147483648.0

    @F.pandas_udf("array<double>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for at in range(0, len(texts), 256):  # so a batch of vectors stays small
                yield pd.Series([vector(t) for t in texts.iloc[at : at + 256]], dtype=object)

    return made(text)


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", column: str = "embedding", min_score: float = 0.0) -> DataFrame:
    """The k most similar rows with ``score``; ties go to the lower id, and a least score only narrows those k. Each task keeps its own k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    found = vectors.withColumn("score", cosine(F.col(column), q)).orderBy(F.desc("score"), id_col).limit(k).withColumn("score", F.round("score", 6))
    return found.filter(F.col("score") >= min_score) if min_score > 0 else found


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", column: str = "embedding", block: int = 8192) -> DataFrame:
    """(query_id, id, score, rank): the k most similar rows of each query, exactly.

    Queries, a stated set, and rows are both dealt by their ids into blocks of about
    ``block``. Each pair of blocks is a group of its own, so a task holds two blocks, the
    driver none, and a row is sent once for each block of queries. A pair hands on its best
    k for each query; what is shuffled then is queries times blocks of rows times k rows.
    Vectors meet those of their length only; null vectors and those that hold a null are
    left out. Ids are taken for unique: rows that repeat one share its block.
    """
    n_queries, n_rows = (F.lit(max(1, -(-df.count() // block))) for df in (queries, vectors))
    asked = _dealt(queries, id_col, column, "query_block", n_queries).withColumn("row_block", F.explode(F.sequence(F.lit(0), n_rows - 1)))
    rows = _dealt(vectors, id_col, column, "row_block", n_rows).withColumn("query_block", F.explode(F.sequence(F.lit(0), n_queries - 1)))
    keys = ("query_block", "row_block", "dim")
    every = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_best(k), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def _dealt(df: DataFrame, id_col: str, column: str, name: str, n: Column) -> DataFrame:
    whole = df.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v")).filter(F.forall("v", lambda x: x.isNotNull()))
    return whole.withColumn("dim", F.size("v")).withColumn(name, F.pmod(F.xxhash64("id"), n).cast("int"))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and their lengths; that of a zero vector is infinite, so its scores are 0."""
    values = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
    length = np.linalg.norm(values, axis=1)
    length[length == 0] = np.inf
    return t.column("id").to_numpy(), values, length


def _best(k: int, at_once: int = 512):  # noqa: ANN202
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and rows.num_rows:
            (query_ids, queries, query_length), (ids, matrix, length) = _matrix(asked), _matrix(rows)
            order = np.argsort(ids, kind="stable")  # among equal scores the first is the least id
            ids, matrix, length = ids[order], matrix[order], length[order]
            for at in range(0, len(query_ids), at_once):
                part = slice(at, at + at_once)
                scores = np.round((queries[part] @ matrix.T) / query_length[part, None] / length[None, :], TIES)
                least = np.partition(scores, len(ids) - min(k, len(ids)), axis=1)[:, [-min(k, len(ids))]]
                q, r = np.nonzero(scores >= least)  # the best k and what ties with the last
                order = np.lexsort((r, -scores[q, r], q))
                q, r = q[order], r[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, r = q[place < k], r[place < k]
                out.append(pa.table({"query_id": query_ids[part][q], "id": ids[r], "score": scores[q, r]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return run


def top_k_per_index(vectors: DataFrame, query: list[float], k: int, index: str, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k most similar rows of every index; those of an index that has none are empty."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(index, id_col, cosine(F.col(column), q).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(index).orderBy(F.desc("score"), id_col))).filter(F.col("rank") <= k)
    return ranked.withColumn("score", F.round("score", 6))


def _full(graph: DataFrame, vector: DataFrame, key: str) -> DataFrame:
    g = graph.select(key, F.col("score").alias("g_score"), *([F.col("rank").alias("g_rank")] if "rank" in graph.columns else []))
    v = vector.select(key, F.col("score").alias("v_score"), *([F.col("rank").alias("v_rank")] if "rank" in vector.columns else []))
    return g.join(v, key, "full")


def reciprocal_rank_fusion(graph: DataFrame, vector: DataFrame, key: str, graph_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """Sum of weight / (60 + rank) over two ranked lists (rank from 1), best first; equal scores keep the graph list's order before the vector list's."""
    part = lambda rank, w: F.when(F.col(rank).isNotNull(), F.lit(w) / (RRF_K + F.col(rank))).otherwise(0.0)
    return _full(graph, vector, key).select(key, F.round(part("g_rank", graph_weight) + part("v_rank", vector_weight), 9).alias("score"), F.struct(F.col("g_rank").isNull().alias("late"), F.coalesce("g_rank", "v_rank").alias("rank")).alias("first_seen"))


def weighted_sum(graph: DataFrame, vector: DataFrame, key: str, graph_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    return _full(graph, vector, key).select(key, F.round(F.coalesce("g_score", F.lit(0.0)) * graph_weight + F.coalesce("v_score", F.lit(0.0)) * vector_weight, 6).alias("score"))


def other_fusion(graph: DataFrame, vector: DataFrame, key: str, how: str) -> DataFrame:
    """``max``, ``min`` or ``average`` of the scores that there are."""
    pick = {"max": F.greatest("g_score", "v_score"), "min": F.least("g_score", "v_score"), "average": (F.coalesce("g_score", "v_score") + F.coalesce("v_score", "g_score")) / 2}[how]
    return _full(graph, vector, key).select(key, F.round(pick, 6).alias("score"))


def reranked(found: DataFrame, query: str, text: str = "text", exact: float = 1.5, long: float = 0.9, longest: int = 500) -> DataFrame:
    """Scores raised where the text holds the query and lowered where it is long, 1 at most."""
    boost = F.when(F.contains(F.lower(text), F.lit(query.lower())), exact).otherwise(1.0) * F.when(F.length(text) > longest, long).otherwise(1.0)
    return found.withColumn("score", F.round(F.least(F.col("score") * boost, F.lit(1.0)), 6))


def context_boosted(found: DataFrame, entities: list[str], text: str = "text", boost: float = 1.2) -> DataFrame:
    """Scores raised once if the text holds any entity, 1 at most."""
    holds = F.exists(F.array(*[F.lit(e.lower()) for e in entities]), lambda e: F.contains(F.lower(text), e)) if entities else F.lit(False)
    return found.withColumn("score", F.round(F.least(F.col("score") * F.when(holds, boost).otherwise(1.0), F.lit(1.0)), 6))
