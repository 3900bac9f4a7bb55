"""What a cache with a bound on its entries and their age answers, for a whole log of requests at once.

An entry is in the cache if fewer than ``capacity`` other keys were asked for since its key
was: that depends on the order of requests alone, hit or not. So the log is cut into
ranges of time; a range's last ``capacity`` keys are all that later ranges need of it, and
merging such lists by doubling gives each range the keys before it in as many steps as the
logarithm of the number of ranges. Then each range goes through its own requests. Age counts from the last miss
of a key, a fold over the key's requests in order.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.storage import stored

#: The defaults of a cache of answers: entries, and seconds.
CAPACITY = 1000
TTL_SECONDS = 3600


def _latest(rows: DataFrame, capacity: int) -> DataFrame:
    """(range, key, us, id): the last keys of each range, each with its last request."""
    last = rows.groupBy("range", "key").agg(F.max(F.struct("us", "id")).alias("at")).select("range", "key", "at.*")
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("us"), F.desc("id")))
    return last.withColumn("place", place).filter(F.col("place") <= capacity).drop("place")


def cached(requests: DataFrame, key: list[str], at: str, tie: str, capacity: int = CAPACITY, ranges: int | None = None) -> DataFrame:
    """(id, key, us, cached): whether a request's key is among the ``capacity`` last ones before it. ``tie`` is a unique number that orders requests of one time; rows without a time are left out."""
    known = requests.filter(F.col(at).isNotNull()).select(F.col(tie).cast("long").alias("id"), F.to_json(F.struct(*key)).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    parted = known.repartitionByRange(ranges, "us", "id") if ranges else known.repartitionByRange("us", "id")
    rows = stored(parted.withColumn("range", F.spark_partition_id()), "requests")
    before, step, n = stored(_latest(rows, capacity), "latest"), 1, (rows.agg(F.max("range")).first()[0] or 0) + 1
    while step < n:
        shifted = before.withColumn("range", F.col("range") + step).filter(F.col("range") < n)
        before, step = stored(_latest(before.unionByName(shifted), capacity), "latest"), 2 * step
    state = before.withColumn("range", F.col("range") + 1).filter(F.col("range") < n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, OrderedDict()
        for batch in batches:
            out = []
            for r, asked, k, us, i in zip(batch["range"], batch["asked"], batch["key"], batch["us"], batch["id"], strict=True):
                if r != current:
                    current, held = r, OrderedDict()
                if asked:
                    out.append((i, k, us, k in held))
                held[k] = True
                held.move_to_end(k)
                if len(held) > capacity:
                    held.popitem(last=False)
            yield pd.DataFrame(out, columns=["id", "key", "us", "cached"])

    every = state.withColumn("asked", F.lit(False)).unionByName(rows.withColumn("asked", F.lit(True)))
    return every.repartition("range").sortWithinPartitions("range", "asked", "us", "id").mapInPandas(run, "id long, key string, us long, cached boolean")


def hits(requests: DataFrame, key: list[str], at: str, tie: str, capacity: int = CAPACITY, ttl: int = TTL_SECONDS, ranges: int | None = None) -> DataFrame:
    """(id, cached, hit): a hit is in the cache and was put there ``ttl`` seconds ago at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, made = None, 0
        for batch in batches:
            out = []
            for k, us, i, held in zip(batch["key"], batch["us"], batch["id"], batch["cached"], strict=True):
                hit = bool(held) and k == current and us - made <= ttl * 1_000_000
                if not hit:
                    current, made = k, us
                out.append((i, held, hit))
            yield pd.DataFrame(out, columns=["id", "cached", "hit"])

    found = cached(requests, key, at, tie, capacity, ranges)
    return found.repartition("key").sortWithinPartitions("key", "us", "id").mapInPandas(run, "id long, cached boolean, hit boolean")
