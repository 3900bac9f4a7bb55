"""Links of names by the ratio of matching characters, without comparing all pairs and without losing a link.

The ratio is 2 M / T: M characters match in order, T is the length of both names. So M is
at most their longest common subsequence, and a ratio of r needs at least ceil(r T / 2)
common characters. Each character that a name loses takes q of its q-grams, each one it
gains parts at most q - 1, so names with that ratio share at least
(2 q - 1) ceil(r T / 2) - (q - 1) (T - 1) q-grams, ends padded, of which repeated ones are
numbered. A name's grams are put in order from the rarest on, and a pair that shares so
many meets in a prefix that leaves out one gram less. What one name loses and gains to
become the other is T - 2 M characters at most, and their edit distance is no more, so
only pairs within that distance are compared exactly. Names are few bytes for much work,
so they are dealt to as many tasks as a shuffle has parts, whatever their size. Equal names stand for each other, so no group of copies is a group of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.storage import stored

THRESHOLD = 0.8
PAD = "\x00"


def gram_size(threshold: float) -> int:
    """The largest q, 3 at most, for which every pair of the threshold shares a gram."""
    for q in (3, 2, 1):
        if (2 * q - 1) * threshold >= 2 * (q - 1):
            return q
    raise ValueError("the threshold is between 0 and 1")


def _least(total: Column, threshold: float, q: int) -> Column:
    """How many grams two names of so many characters in all share at least."""
    # Rounded before the ceiling, so that 0.8 * 5 / 2 is 2 and not a little more.
    matching = F.ceil(F.round(total * F.lit(threshold / 2), 9))
    return F.greatest(F.lit(1), (2 * q - 1) * matching - (q - 1) * (total - 1)).cast("int")


def _least_from(total: Column, threshold: float, q: int) -> Column:
    """The same for two names of so many characters and more: without the first ceiling the bound grows with the number."""
    return F.greatest(F.lit(1), F.ceil(F.round(total * F.lit((2 * q - 1) * threshold / 2 - (q - 1)), 9)) + (q - 1)).cast("int")


def _grams(name: Column, q: int) -> Column:
    """The name's q-grams, ends padded; the k-th of equal ones is numbered k."""
    padded = F.concat(F.lit(PAD * (q - 1)), name, F.lit(PAD * (q - 1)))
    each = F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.substring(padded, i, F.lit(q)))
    # Sorted, equal grams stand side by side and their number is the distance to the first.
    ordered = F.sort_array(each)
    return F.transform(ordered, lambda g, i: F.concat_ws(":", g, (i - F.array_position(ordered, g) + 1).cast("string")))


def _ratios(pairs: DataFrame, threshold: float) -> DataFrame:
    """The exact ratio of each pair (query, name), where it reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matcher, last = [], SequenceMatcher(None), None
            for query, name in zip(batch.column("query").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if name != last:  # the matcher keeps what it knows of the second name
                    matcher.set_seq2(name)
                    last = name
                matcher.set_seq1(query)
                if matcher.real_quick_ratio() >= threshold and (score := matcher.ratio()) >= threshold:
                    rows.append((query, name, score))
            query, name, score = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.string()), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=["query", "name", "score"])

    return pairs.mapInArrow(run, "query string, name string, score double")


def similar(queries: DataFrame, names: DataFrame, query: str, name: str, threshold: float = THRESHOLD) -> DataFrame:
    """(query, name, score) of all pairs of distinct lower-case strings whose ratio is at least the threshold. Nulls and empty strings are none."""
    q = gram_size(threshold)
    distinct = lambda df, c: df.select(F.lower(c).alias("name")).filter("name <> ''").distinct()
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = distinct(queries, query).withColumn("asked", F.lit(True)).unionByName(distinct(names, name).withColumn("asked", F.lit(False)))
    # By a hash of the name, since the distinct rows are parted by the name itself and would stay in few tasks.
    sides = stored(both.repartition(tasks, F.xxhash64("name")).withColumn("grams", _grams(F.col("name"), q)), "named")
    common = sides.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    n = F.length("name")
    shortest = F.ceil(F.round(n * F.lit(threshold / (2 - threshold)), 9))
    # A partner is no shorter than this, and the longer it is, the higher the bound.
    kept = F.size("grams") - _least_from(n + shortest, threshold, q) + 1
    ranked = sides.select("name", "asked", n.alias("length"), kept.alias("kept"), F.explode("grams").alias("gram")).join(common, "gram").repartition(tasks, "name")
    place = F.row_number().over(Window.partitionBy("name", "asked").orderBy("n", "gram"))
    prefix = ranked.withColumn("place", place).filter(F.col("place") <= F.col("kept")).select("name", "asked", "length", "gram")
    prefix = stored(prefix, "prefixes")
    left, right = (prefix.filter(F.col("asked") == a).select(F.col("name").alias(c), F.col("length").alias(f"{c}_length"), "gram") for a, c in ((True, "query"), (False, "name")))
    fits = F.least("query_length", "name_length") * (2 - threshold) >= F.greatest("query_length", "name_length") * threshold - 1e-9
    total = F.col("query_length") + F.col("name_length")
    near = F.levenshtein("query", "name") <= total - 2 * F.ceil(F.round(total * F.lit(threshold / 2), 9))
    pairs = left.join(right, "gram").filter(fits & near).select("query", "name").repartition(tasks, "query", "name").distinct()
    return _ratios(pairs, threshold)


def best_link(queries: DataFrame, names: DataFrame, query: str, name: str, value: str, threshold: float = THRESHOLD) -> DataFrame:
    """(query, value, score): for each lower-case query the value of the name with the highest ratio; of equal ratios, and of names with several values, the least value."""
    found = similar(queries, names, query, name, threshold)
    valued = names.select(F.lower(name).alias("name"), F.col(value).alias("value")).groupBy("name").agg(F.min("value").alias("value"))
    best = found.join(valued, "name").groupBy("query").agg(F.max(F.struct("score")).alias("top"), F.min_by("value", F.struct((-F.col("score")).alias("s"), F.col("value").alias("v"))).alias("value"))
    return best.select("query", F.col("value").alias(value), F.col("top.score").alias("score"))


def exact_link(df: DataFrame, names: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """``df`` with ``key_``, the lower-case name, and ``exact_``, the least value of that name; null if there is none."""
    exact = names.select(F.lower(name).alias("key_"), F.col(value).alias("exact_")).groupBy("key_").agg(F.min("exact_").alias("exact_"))
    return df.withColumn("key_", F.lower(by)).join(exact, "key_", "left")


def linked(df: DataFrame, names: DataFrame, by: str, name: str, value: str, code: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``value``, ``match_score`` and ``match_method``: the name as it is in either case, else a code of a letter and two digits within it, else the most similar name.

    Only what the first two stages leave is compared for likeness.
    """
    out = exact_link(df, names, by, name, value)
    if code is not None:
        codes = names.filter(F.col(code).isNotNull()).select(F.col(code).alias("code_"), F.col(value).alias("by_code_")).groupBy("code_").agg(F.min("by_code_").alias("by_code_"))
        out = out.withColumn("code_", F.nullif(F.regexp_extract(by, r"\b([A-Z][0-9]{2})\b", 1), F.lit(""))).join(codes, "code_", "left")
    else:
        out = out.withColumn("by_code_", F.lit(None).cast(names.schema[value].dataType))
    out = stored(out, "exact")
    rest = best_link(out.filter("exact_ is null and by_code_ is null").select("key_"), names, "key_", name, value, threshold)
    rest = rest.select(F.col("query").alias("key_"), F.col(value).alias("fuzzy_"), "score")
    # A key that is linked exactly has no likeness, so a frequent exact name is no hot key here.
    out = out.withColumn("open_", F.when(F.col("exact_").isNull() & F.col("by_code_").isNull(), F.col("key_")))
    out = out.drop("key_").join(rest.withColumnRenamed("key_", "open_"), "open_", "left")
    method = F.when(F.col("exact_").isNotNull(), "exact").when(F.col("by_code_").isNotNull(), "kcd").when(F.col("fuzzy_").isNotNull(), "fuzzy").otherwise("none")
    score = F.when(method.isin("exact", "kcd"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return out.select(*df.columns, F.coalesce("exact_", "by_code_", "fuzzy_").alias(value), score.alias("match_score"), method.alias("match_method"))
