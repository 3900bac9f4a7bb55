"""Numbers of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.storage import stored


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``number``, from 0 in the order of some columns; rows equal in all of them are numbered in any order.

    Rows are range-partitioned and counted by range; a range's first number is the sum
    of the counts before it, a table of one row a range.
    """
    ranges = stored(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("range_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return ranges.withColumn("own_", own).join(F.broadcast(starts), "range_").withColumn("number", F.col("start_") + F.col("own_") - 1).drop("range_", "own_", "start_")
