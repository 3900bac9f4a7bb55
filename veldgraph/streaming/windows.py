"""Structured Streaming: rate limits, metrics, upserts and windows. The same functions take batch tables where Spark allows it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from veldgraph.storage import scratch_path

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def tumbling(events: DataFrame, size: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and keys; rows later than ``late`` are dropped by a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, slide: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size, slide), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def metrics(events: DataFrame) -> DataFrame:
    """Running counts and sums by type; ends in update or complete mode."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last"))


def rate_limited(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """Each event with its number in its user's window and whether it is allowed.

    A window opens at a user's first event and closes when more than ``seconds`` have
    passed; the next event opens another. That is a fold in order: a task reads its
    users' events sorted and keeps one window's start and count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, since, n = None, None, 0
        for rows in batches:
            out = []
            for u, event_id, at in zip(rows["user_id"], rows["event_id"], rows["us"], strict=True):
                if u != user or at - since > seconds * 1_000_000:
                    user, since, n = u, at, 0
                n += 1
                out.append((u, event_id, n, n <= most, max(0, most - n)))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "n", "allowed", "remaining"])

    known = events.filter("user_id is not null and ts is not null").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return known.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInPandas(run, "user_id bigint, event_id bigint, n int, allowed boolean, remaining int")


def rate_limited_stream(events: DataFrame, most: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """The same on a stream: each event's verdict, once the watermark has passed the event.

    An event is held in its user's state until no earlier one can come, so the fold is
    in order across Arrow chunks, files and micro-batches. The state holds the open
    window's start and count, and the events of the last ``late``. Events later than
    that are dropped.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, n, at, ids = state.get if state.exists else (None, 0, [], [])
        waiting = list(zip(at or [], ids or [], strict=True))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += [(int(ts.value // 1000), int(i)) for i, ts in zip(rows["event_id"], rows["ts"], strict=True)]
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ready = [x for x in waiting if x[0] < passed]
        waiting, out = waiting[len(ready) :], []
        for us, event_id in ready:
            if since is None or us - since > seconds * 1_000_000:
                since, n = us, 0
            n += 1
            out.append((key[0], event_id, n, n <= most, max(0, most - n)))
        if not waiting and since is not None and passed - since > seconds * 1_000_000:
            state.remove()
        else:
            state.update((since, n, [x[0] for x in waiting], [x[1] for x in waiting]))
            due = waiting[0][0] // 1000 + 1 if waiting else (since or 0) // 1000 + 1000 * seconds + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "n", "allowed", "remaining"])

    known = events.withWatermark("ts", late).filter("user_id is not null and ts is not null")
    return known.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(
        fold, "user_id bigint, event_id bigint, n int, allowed boolean, remaining int", "since bigint, n int, at array<bigint>, ids array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def latest(progress: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The newest value of each key."""
    return progress.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def cache_hits(events: DataFrame, key: list[str], ttl_seconds: int) -> DataFrame:
    """Each event with whether the same request within the time to live came before it: a cache without a size limit, renewed by each request."""
    w = Window.partitionBy(*key).orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1_000_000
    return events.select("event_id", *key, F.coalesce(age <= ttl_seconds, F.lit(False)).alias("hit"))


def drained(stream: DataFrame, name: str, use: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame | None:
    """Runs a stream over what is there now, with its checkpoint in the shared folder; without ``use`` its rows are returned."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True)
    if use is not None:
        writer.foreachBatch(use).start().awaitTermination()
        return None
    path = scratch_path(spark, name)
    if mode == "append":
        writer.format("parquet").start(path).awaitTermination()
    else:
        writer.foreachBatch(lambda df, _n: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.parquet(path)
