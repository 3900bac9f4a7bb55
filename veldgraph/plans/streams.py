"""Streaming queries over the events, each drained once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldgraph.plans import Plans, Tables
from veldgraph.storage import scratch_path
from veldgraph.streaming import lru, upkeep, windows

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
LIMITED = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, k, us AS since, 1 AS n FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.us - w.since > 36000000000 THEN e.us ELSE w.since END, CASE WHEN e.us - w.since > 36000000000 THEN 1 ELSE w.n + 1 END
 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id, n, n <= 3 AS allowed, greatest(0, 3 - n)::INT AS remaining FROM w"""


def _stream(t: Tables) -> DataFrame:
    """The events as a stream of files."""
    path = scratch_path(t.spark, "events")
    t.events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return t.spark.readStream.schema(windows.EVENT).option("maxFilesPerTrigger", 4).parquet(path)


#: Rows of a file of a slice, or so.
SLICED = 1_000_000


def _slices(t: Tables, disorder: int = 0, slices: int = 5) -> DataFrame:
    """The events as a stream of files that follow in time, with up to ``disorder`` microseconds of disorder between them, a slice a batch. A slice has as many files as all events need, so none is written by one task."""
    path = scratch_path(t.spark, "ordered")
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    shaken = F.unix_micros("ts") + (F.pmod(F.xxhash64("event_id"), F.lit(disorder)) if disorder else F.lit(0))
    first, last, rows = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")) + disorder, F.count("*")).first()
    files = -(-rows // (slices * SLICED)) or 1
    for k in range(slices):
        low, high = (first + (last + 1 - first) * x // slices for x in (k, k + 1))
        events.filter((shaken >= low) & (shaken < high)).repartition(files).write.mode("append").parquet(path)
    return t.spark.readStream.schema(windows.EVENT).option("maxFilesPerTrigger", files).parquet(path)


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@P.add(LIMITED)
def st_rate_limit(t: Tables) -> DataFrame:
    """Three events in ten hours from a user's first one."""
    return windows.rate_limited(t.events, 3, 36_000)


@P.add(LIMITED + " WHERE event_id IN (SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY)")
def st_rate_limit_stream(t: Tables) -> DataFrame:
    """The stateful form: the verdicts of all events that the watermark has passed, a day before the last one. The stream's files follow in time, with half a day of disorder between them."""
    stream = _slices(t, disorder=43_200_000_000)
    return windows.drained(windows.rate_limited_stream(stream, 3, 36_000, late="1 day"), "limited")


@P.add("SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_rate_table(t: Tables) -> DataFrame:
    return _naive(windows.tumbling(t.events, "6 hours", "user_id"), "window_start").select("user_id", "window_start", "n", F.round("total", 4).alias("total"))


@P.add("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL")
def st_tumbling_stream(t: Tables) -> DataFrame:
    """Days that the watermark, a day behind the last event, has closed, of a stream in append mode whose files follow in time."""
    out = windows.drained(windows.tumbling(_slices(t), "1 day", "event_type", late="1 day"), "tumbling")
    return _naive(out, "window_start").select("event_type", "window_start", "n")


@P.add("SELECT b AS window_start, event_type, count(*) AS n FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS b FROM events) GROUP BY ALL")
def st_sliding(t: Tables) -> DataFrame:
    """An addition: windows of twelve hours every six."""
    return _naive(windows.sliding(t.events, "12 hours", "6 hours", "event_type"), "window_start").select("window_start", "event_type", "n")


@P.add("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def st_session(t: Tables) -> DataFrame:
    """An addition: sessions that twelve hours without an event end."""
    return _naive(windows.sessions(t.events, "12 hours", "user_id"), "session_start", "session_end")


@P.add("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def st_metrics(t: Tables) -> DataFrame:
    out = windows.drained(windows.metrics(_stream(t)), "metrics", mode="complete")
    return out.select("event_type", "n", F.round("total", 4).alias("total"))


@P.add("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def st_progress(t: Tables) -> DataFrame:
    """Batches are kept once each; the newest row of a user counts."""
    path = scratch_path(t.spark, "progress")
    windows.drained(_stream(t), "progress", upkeep.append_once(path, lambda df: df.select("user_id", "event_id", "ts", "event_type")))
    return windows.latest(t.spark.read.parquet(path), "user_id", ["ts", "event_id"], "event_type")


@P.add("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def st_poll(t: Tables) -> DataFrame:
    """Files are found batch by batch; a batch that is run again replaces itself."""
    path = scratch_path(t.spark, "polled")
    sink = upkeep.append_once(path, lambda df: df.select("event_id"))

    def twice(df: DataFrame, batch: int) -> None:
        sink(df, batch)
        sink(df, batch)

    windows.drained(_slices(t), "polled", twice)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


def _kept_up(t: Tables) -> upkeep.GraphUpkeep:
    """Users and types as nodes, what users did as edges, merged batch by batch; the last batch comes twice."""
    kept, user, kind = upkeep.GraphUpkeep(t.spark, scratch_path(t.spark, "upkeep"), buckets=4), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("t"), F.col("event_type"))

    def use(df: DataFrame, batch: int) -> None:
        nodes = df.select(user.alias("node_id"), F.lit("User").alias("label")).unionByName(df.select(kind.alias("node_id"), F.lit("Type").alias("label")))
        edges = df.select(user.alias("src"), kind.alias("dst"), F.lit("DID").alias("rel_type"))
        kept.apply(nodes, edges, batch)
        kept.apply(nodes, edges, batch)

    windows.drained(_slices(t, slices=3), "upkeep", use)
    return kept


@P.add("SELECT 'u' || user_id AS src, 't' || event_type AS dst, 'DID' AS rel_type, count(*) AS weight FROM events GROUP BY ALL")
def st_graph_upkeep(t: Tables) -> DataFrame:
    """The graph after the last batch: that of a rebuild from all events."""
    return _kept_up(t).edges.read()


@P.add("SELECT 'node' AS kind, 'User' AS name, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'node', 'Type', count(DISTINCT event_type) FROM events UNION ALL SELECT 'edge', 'DID', count(DISTINCT (user_id, event_type)) FROM events")
def st_graph_counts(t: Tables) -> DataFrame:
    return _kept_up(t).counts.read()


_EDGE = "CASE WHEN length(bin(v)) > 8 THEN (v >> (length(bin(v)) - 8)::INT) << (length(bin(v)) - 8)::INT ELSE v END"


@P.add(f"""
WITH x AS (SELECT event_type, round(value * 100)::BIGINT AS v FROM events), b AS (SELECT event_type, list_sort(list({_EDGE})) AS l, count(*) AS n FROM x GROUP BY event_type)
SELECT event_type, n, l[least(floor(n * 0.5), n - 1)::INT + 1] AS p50, l[least(floor(n * 0.95), n - 1)::INT + 1] AS p95, l[least(floor(n * 0.99), n - 1)::INT + 1] AS p99 FROM b""")
def st_percentiles(t: Tables) -> DataFrame:
    """Percentiles of hundredths from counts by bucket that a stream keeps; see the error in ``upkeep.quantiles``."""
    kept = windows.drained(upkeep.sketched(_slices(t), ["event_type"], F.round(F.col("value") * 100).cast("long")), "sketch", mode="complete")
    return upkeep.quantiles(kept, ["event_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@P.add("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY event_type")
def st_learner_poll(t: Tables) -> DataFrame:
    """What is pending is drained in bounded batches."""
    out = windows.drained(_stream(t).filter("event_type in ('error', 'signup')").select("event_id", "event_type"), "pending")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@P.add("""
WITH e AS (SELECT event_id, (user_id, event_type) AS k, row_number() OVER (ORDER BY ts, event_id) AS place FROM events),
p AS (SELECT event_id, k, place, lag(place) OVER (PARTITION BY k ORDER BY place) AS before FROM e),
d AS (SELECT p.event_id, count(DISTINCT e.k) AS n FROM p JOIN e ON e.place > p.before AND e.place < p.place GROUP BY p.event_id)
SELECT event_id, before IS NOT NULL AND coalesce(n, 0) < 100 AS cached FROM p LEFT JOIN d USING (event_id)""")
def st_cache_lru(t: Tables) -> DataFrame:
    """Which requests a cache of a hundred entries holds when they come."""
    return lru.cached(t.events, ["user_id", "event_type"], "ts", "event_id", 100).select(F.col("id").alias("event_id"), "cached")


@P.add()
def st_cache_lru_ttl(t: Tables) -> DataFrame:
    """Hits of a cache with a thousand entries for an hour each; tests compare with an ordered dictionary."""
    return lru.hits(t.events, ["user_id", "event_type"], "ts", "event_id")


@P.add("""
WITH h AS (SELECT event_id, user_id, event_type, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) <= 86400000000, false) AS hit FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (hit) AS hits FROM h GROUP BY event_type""")
def st_cache_ttl(t: Tables) -> DataFrame:
    found = windows.cache_hits(t.events, ["user_id", "event_type"], 86_400)
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
