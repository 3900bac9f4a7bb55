"""An inverted index of texts: a table of postings by term, and searches that open only the buckets of their terms.

A posting is a term, a document, the sum of the fields' weights over its occurrences, and
its places. Postings lie in folders by a bucket of the term, sorted by term within a
file, so a search reads a few folders and, by Parquet's statistics, few row groups. A
document's postings are made in the task that reads it and written from there, so none
are shuffled, and a term that most documents hold is spread over the files of all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldgraph.operators.filters import tokens
from veldgraph.storage import stored

BUCKETS = 32
#: Postings of the rarest term up to this number go to the tasks that read the others'; more are shuffled.
SENT = 100_000
#: What the places of one field are apart from those of the next, so no phrase spans two.
GAP = 1 << 40
#: Words that are put in order at once within a task; a document is not parted.
WORDS = 2_000_000
POSTINGS = "term string, id long, weight double, places array<long>, bucket int"


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    buckets: int

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _buckets(self, words: list[str]) -> list[int]:
        """The buckets of a query's words, as Spark hashes them."""
        asked = self.spark.createDataFrame([(w,) for w in words], "term string")
        return sorted({r[0] for r in asked.select(self.bucket(F.col("term"))).collect()})

    def postings(self, words: list[str]) -> DataFrame:
        """The postings of some terms; other buckets' folders are not opened."""
        rows = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        return rows.filter(F.col("bucket").isin(self._buckets(words)) & F.col("term").isin(words))

    def counts(self, words: list[str]) -> dict[str, int]:
        """How many documents hold each of a query's words; of the postings only the terms are read."""
        found = self.postings(words).groupBy("term").agg(F.count("*").alias("documents")).collect()  # a row a word
        return {w: 0 for w in words} | {r["term"]: r["documents"] for r in found}


def _postings(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(term, id, weight, places) of each row (id, text fields), made in the row's task; runs of about ``WORDS`` words are in the order of term and row."""
    fields, gap, most = list(weights), GAP, WORDS  # what a task needs, without this module

    def posted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([p.column("id") for p in held])
        sizes = [np.concatenate([np.diff(p.column(c).offsets.to_numpy()) for p in held]).astype(np.int64) for c in fields]
        coded = pa.concat_arrays([p.column(c).flatten() for c in fields for p in held]).dictionary_encode()
        # The terms' numbers in their order, so that one sort of whole numbers is enough.
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
        place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + k * gap for k, n in enumerate(sizes)])
        weight = np.repeat([float(weights[c]) for c in fields], [n.sum() for n in sizes])
        key = rank[coded.indices.to_numpy()] * len(ids) + row
        order = np.argsort(key, kind="stable")  # places of a row's term stay in order
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        summed = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[order], pa.int64()))
        at = order[first]
        columns = [coded.dictionary.take(coded.indices.take(pa.array(at))), ids.take(pa.array(row[at])), pa.array(summed, pa.float64()), places]
        return pa.RecordBatch.from_arrays(columns, names=["term", "id", "weight", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            words = np.cumsum(sum(np.diff(batch.column(c).offsets.to_numpy()).astype(np.int64) for c in fields))
            begin = 0
            while begin < len(words):
                before = words[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(words, before + most - n, "right")))
                held.append(batch.slice(begin, end - begin))
                n += int(words[end - 1] - before)
                begin = end
                if n >= most or end < len(words):
                    made, held, n = posted(held), [], 0
                    yield from (made.slice(k, 100_000) for k in range(0, len(made), 100_000))
        if held:
            made = posted(held)
            yield from (made.slice(k, 100_000) for k in range(0, len(made), 100_000))

    split = rows.select("id", *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in fields])
    return split.mapInArrow(run, "term string, id long, weight double, places array<long>")


def written(df: DataFrame, path: str, id_col: str, weights: dict[str, float], buckets: int = BUCKETS) -> Index:
    """Writes the index of the weighted text columns. Rows without an id are left out; rows that repeat one are one document. Null texts have no terms."""
    index = Index(df.sparkSession, path, buckets)
    known = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *weights)
    several = stored(known.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    if several.isEmpty():
        postings = _postings(known, weights)
    else:  # only these rows meet by document
        met = _postings(known.join(several, "id", "left_semi"), weights).groupBy("term", "id")
        met = met.agg(F.sum("weight").alias("weight"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
        postings = _postings(known.join(several, "id", "left_anti"), weights).unionByName(met)
    postings = postings.withColumn("bucket", index.bucket(F.col("term")))
    postings.sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    return index


def search(index: Index, query: str, phrase: bool = False) -> DataFrame:
    """(id, rank) of the documents that hold all words of the query, with ``phrase`` one after the other in one field: the sum of weights over occurrences.

    Terms meet from the rarest on. As long as few documents are left they are sent to
    where the next term's postings are read, so long postings are not shuffled.
    """
    spark = index.spark
    words = [r["w"] for r in spark.createDataFrame([(query,)], "q string").select(F.explode(tokens(F.col("q"))).alias("w")).collect()]
    counts = index.counts(sorted(set(words))) if words else {}
    if not words or min(counts.values()) == 0:
        return spark.createDataFrame([], "id long, rank double")
    order = sorted(counts, key=lambda w: (counts[w], w))
    # Where the phrase begins, by each place of a word in the query.
    begins_at = lambda k: F.transform("places", lambda x: x - k)
    starts = {w: [begins_at(k) for k, v in enumerate(words) if v == w] for w in order}
    postings, found = index.postings(order), None
    for w in order:
        own = postings.filter(F.col("term") == w)
        begin = starts[w][0]
        for other in starts[w][1:]:
            begin = F.array_intersect(begin, other)
        own = own.select("id", F.col("weight").alias("own"), (begin if phrase else F.array(F.lit(0))).alias("begins"))
        if found is None:
            found = own.withColumnRenamed("own", "rank")
        else:
            few = F.broadcast(found) if counts[order[0]] <= SENT else found
            met = own.withColumnRenamed("begins", "more").join(few, "id")
            found = met.select("id", (F.col("rank") + F.col("own")).alias("rank"), (F.array_intersect("begins", "more") if phrase else F.col("begins")).alias("begins"))
        if phrase:
            found = found.filter(F.size("begins") > 0)
    return found.select("id", F.round("rank", 6).alias("rank"))
