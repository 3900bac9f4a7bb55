"""Aggregates with the conventions of the dashboards: filtered counts, index percentiles, guarded rates and last-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def index_percentile(values: str, share: float) -> Column:
    """The element at floor(n * share) of the sorted values, as an aggregate; null of nothing.

    The group's values come together in one array, so this suits bounded groups;
    see ``index_percentiles`` for any size.
    """
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, F.least(F.floor(F.size(ordered) * F.lit(share)).cast("int"), F.size(ordered) - 1))


def index_percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The same for groups of any size: equal values are counted first, and the running count finds the place."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n_"))
    run = Window.partitionBy(*group).orderBy(value)
    placed = counts.withColumns({"end_": F.sum("n_").over(run), "all_": F.sum("n_").over(Window.partitionBy(*group))})
    at = lambda share: F.least(F.floor(F.col("all_") * F.lit(share)), F.col("all_") - 1)
    hits = {name: F.min(F.when(F.col("end_") > at(share), F.col(value))).alias(name) for name, share in shares.items()}
    return placed.groupBy(*group).agg(*hits.values())


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 if there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def last_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rn_") <= n).drop("rn_")


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys; ties go to the lower key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), key).limit(n)


def zero_filled(df: DataFrame, key: str, known: list[str]) -> DataFrame:
    """Counts of the known keys, zeros included."""
    every = df.sparkSession.createDataFrame([(k,) for k in known], f"{key} string")
    return every.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
