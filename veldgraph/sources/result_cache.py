"""Results kept by the hash of the content that they were computed from, with an expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldgraph.operators.sinks import upsert
from veldgraph.sources.snapshots import SnapshotTable
from veldgraph.storage import stored

#: Thirty days.
TTL_SECONDS = 2_592_000
KEY = ["content_hash"]


def cached(texts: DataFrame, column: str, compute: Callable[[DataFrame], DataFrame], table: SnapshotTable, now: int, ttl: int = TTL_SECONDS) -> DataFrame:
    """``texts`` with ``result`` and ``hit``: whether the result was in the table before this call.

    ``compute`` takes (content_hash, text) of distinct contents and returns (content_hash,
    result). It gets only what the table doesn't hold or holds no longer at the time ``now``, in
    seconds. New results are merged with their expiry; equal contents are computed once.
    A null text is no content: its result is null and no hit.
    """
    marked = texts.withColumn("content_hash", F.sha2(column, 256))
    asked = stored(marked.filter("content_hash is not null").groupBy("content_hash").agg(F.first(column).alias("text")), "asked")
    fresh = lambda df: df.filter(F.col("expires") > now).select("content_hash", "result")
    known = fresh(table.read()) if table.versions() else None
    missing = stored(asked if known is None else asked.join(known, KEY, "left_anti"), "missing")
    if not missing.isEmpty():
        found = compute(missing).select("content_hash", "result", F.lit(now + ttl).cast("long").alias("expires"))
        table.merge(stored(found, "computed"), lambda old, new: upsert(old, new, KEY, [F.desc("expires")]))
    if not table.versions():
        return texts.withColumns({"result": F.lit(None).cast("string"), "hit": F.lit(False)})
    held = fresh(table.read()).join(asked.select(*KEY), KEY, "left_semi").join(missing.select(*KEY, F.lit(False).alias("was")), KEY, "left")
    sizes = marked.join(held.select(*KEY, "result", F.coalesce("was", F.lit(True)).alias("hit")), KEY, "left")
    return sizes.select(*texts.columns, "result", F.coalesce("hit", F.lit(False)).alias("hit"))
