"""Snapshots, the cache of results, cascades and sinks that a batch may reach twice."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veldgraph.operators import aggregates, cascade, sinks
from veldgraph.sources.result_cache import TTL_SECONDS, cached
from veldgraph.sources.snapshots import Conflict, SnapshotTable
from veldgraph.storage import load, scratch_path
from veldgraph.streaming import upkeep

SF = "/root/testdata/sf0.001"


def _rows(df):  # noqa: ANN001, ANN202
    return sorted(map(tuple, df.collect()), key=str)


def _nodes(spark, *rows):  # noqa: ANN001, ANN202
    return spark.createDataFrame(list(rows), "node_id long, name string")


def _merge(table, rows):  # noqa: ANN001, ANN202
    return table.merge(rows, lambda old, new: sinks.merge_nodes(old, new, "node_id"))


def test_snapshots(spark):
    """Two merges, a third that fails, and a read at each version."""
    table = SnapshotTable(spark, scratch_path(spark, "t"), ["node_id"], buckets=4)
    with pytest.raises(ValueError):
        table.read()
    assert _merge(table, _nodes(spark, (1, "a"), (2, "b"), (3, None))) == 1
    first = table.read()
    assert _merge(table, _nodes(spark, (2, "B"), (3, "c"), (4, "d"))) == 2
    broken = _nodes(spark, (1, "x")).withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        _merge(table, broken)
    assert table.versions() == [1, 2]
    assert _rows(first) == _rows(table.read(1)) == [(1, "a"), (2, "b"), (3, None)]
    assert _rows(table.read()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    with pytest.raises(ValueError):
        table.read(3)


def test_only_touched_buckets_are_written(spark):
    table = SnapshotTable(spark, scratch_path(spark, "t"), ["node_id"], buckets=16)
    _merge(table, _nodes(spark, *[(i, str(i)) for i in range(200)]))
    _merge(table, _nodes(spark, (7, "seven")))
    before, after = (table._listed(v)["folders"] for v in (1, 2))
    assert sum(before[b] != after[b] for b in after) == 1 and len(after) == 16
    assert table.read().count() == 200


def test_an_emptied_bucket_and_a_repeated_version(spark):
    table = SnapshotTable(spark, scratch_path(spark, "t"), ["node_id"], buckets=2)
    _merge(table, _nodes(spark, (1, "a"), (2, "b"), (3, "c")))
    gone = _nodes(spark, (1, None), (2, None), (3, None))
    drop = lambda old, new: sinks.deleted(old, new, "node_id")
    assert table.merge(gone, drop, version=2) == 2
    assert table.read().count() == 0 and table.read(1).count() == 3
    assert table.merge(_nodes(spark, (9, "z")), drop, version=2) == 2  # is there already
    with pytest.raises(ValueError):
        table.merge(gone, drop, version=4)


def test_two_writers(spark):
    """The one that comes second to a version is told so, and nothing of it is seen."""
    table = SnapshotTable(spark, scratch_path(spark, "t"), ["node_id"])
    _merge(table, _nodes(spark, (1, "a")))

    def slow(old, new):  # noqa: ANN001, ANN202
        _merge(table, _nodes(spark, (2, "other writer")))
        return sinks.merge_nodes(old, new, "node_id")

    with pytest.raises(Conflict):
        table.merge(_nodes(spark, (1, "late")), slow)
    assert _rows(table.read()) == [(1, "a"), (2, "other writer")]


def test_cache_computes_what_is_missing(spark):
    asked: list[int] = []

    def compute(missing):  # noqa: ANN001, ANN202
        asked.append(missing.count())
        return missing.select("content_hash", F.upper("text").alias("result"))

    table = SnapshotTable(spark, scratch_path(spark, "c"), ["content_hash"], buckets=2)
    frame = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    assert _rows(cached(frame("a", "b", "a", None), "text", compute, table, 0)) == [(0, "a", "A", False), (1, "b", "B", False), (2, "a", "A", False), (3, None, None, False)]
    assert _rows(cached(frame("a", "b"), "text", compute, table, 10)) == [(0, "a", "A", True), (1, "b", "B", True)]
    assert asked == [2]
    assert _rows(cached(frame("a", "c"), "text", compute, table, 20)) == [(0, "a", "A", True), (1, "c", "C", False)]
    assert asked == [2, 1]
    # Thirty days after the first call a and b have expired, c has not.
    assert [r["hit"] for r in cached(frame("a", "b", "c"), "text", compute, table, TTL_SECONDS).orderBy("id").collect()] == [False, False, True]
    assert asked == [2, 1, 2]
    assert cached(frame(None), "text", compute, SnapshotTable(spark, scratch_path(spark, "c"), ["content_hash"]), 0).first()["hit"] is False


def _plain_doomed(edges, roots):  # noqa: ANN001, ANN202
    out, into = defaultdict(set), defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        into[b].add(a)

    def reach(start, ok):  # noqa: ANN001, ANN202
        seen, todo = set(start), list(start)
        while todo:
            for b in out[todo.pop()]:
                if b not in seen and ok(b):
                    seen.add(b)
                    todo.append(b)
        return seen

    below = reach(roots, lambda _: True)
    held = {n for n in below - roots if into[n] - below}
    return below - reach(held, lambda n: n in below and n not in roots)


@pytest.mark.parametrize("fold", [2, 16])
def test_cascades_equal_a_plain_walk(spark, monkeypatch, fold):
    monkeypatch.setattr(cascade, "FOLD", fold)
    rng = random.Random(fold)
    chain = [(f"k{i}", f"k{i + 1}") for i in range(25)]
    for n_edges in (30, 60):
        edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(n_edges)] + chain + [("k25", "k20"), ("x", "x"), ("x", "x")]
        roots = {f"n{rng.randrange(40)}" for _ in range(4)} | {"k3", "x", "nowhere"}
        got = cascade.doomed(spark.createDataFrame([*edges, (None, "a"), ("a", None)], "src string, dst string"), spark.createDataFrame([(r,) for r in roots], "node_id string"))
        assert {r[0] for r in got.collect()} == _plain_doomed(edges, roots)


def test_no_roots_no_deletes(spark):
    edges = spark.createDataFrame([("a", "b", 1)], "src string, dst string, w int")
    nodes, kept = cascade.deleted(spark.createDataFrame([("a",), ("b",)], "node_id string"), edges, spark.createDataFrame([], "node_id string"))
    assert nodes.count() == 2 and kept.columns == ["src", "dst", "w"] and kept.count() == 1


def test_batches_that_come_again(spark):
    events = load(spark, SF, "events")
    rebuilt = _rows(events.groupBy("user_id", "event_type").count())
    path = scratch_path(spark, "once")
    sink, kept = upkeep.append_once(path), upkeep.GraphUpkeep(spark, scratch_path(spark, "graph"), buckets=3)
    for batch in (0, 1, 2):
        part = events.filter(F.pmod("event_id", F.lit(3)) == batch)
        nodes = part.select(F.col("user_id").cast("string").alias("node_id"), F.lit("User").alias("label"))
        edges = part.select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), F.lit("DID").alias("rel_type"))
        for _ in range(2):
            sink(part, batch)
            kept.apply(nodes, edges, batch)
    assert spark.read.parquet(path).count() == events.count()
    assert _rows(kept.edges.read().select(F.col("src").cast("long"), "dst", "weight")) == sorted(rebuilt, key=str)
    assert {(r["kind"], r["n"]) for r in kept.counts.read().collect()} == {("node", events.select("user_id").distinct().count()), ("edge", len(rebuilt))}


def test_a_batch_that_stopped_between_tables(spark, monkeypatch):
    """Nodes are merged, the edges fail; the batch is run again and nothing counts twice."""
    kept = upkeep.GraphUpkeep(spark, scratch_path(spark, "graph"), buckets=2)
    nodes = spark.createDataFrame([("a", "N"), ("b", "N")], "node_id string, label string")
    edges = spark.createDataFrame([("a", "b", "R"), ("a", "b", "R")], "src string, dst string, rel_type string")
    with monkeypatch.context() as m:
        m.setattr(kept.edges, "merge", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            kept.apply(nodes, edges, 0)
    assert kept.nodes.versions() == [1] and kept.counts.versions() == []
    kept.apply(nodes, edges, 0)
    kept.apply(nodes, edges, 0)
    assert _rows(kept.edges.read()) == [("a", "b", "R", 2)]
    assert _rows(kept.counts.read()) == [("edge", "R", 1), ("node", "N", 2)]


def test_quantiles_of_buckets(spark):
    rows = load(spark, SF, "events").withColumn("v", F.round(F.col("value") * 100).cast("long"))
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    exact = {r["event_type"]: r for r in aggregates.index_percentiles(rows, ["event_type"], "v", shares).collect()}
    whole = upkeep.sketched(rows, ["event_type"], F.col("v"))
    parts = [upkeep.sketched(rows.filter(F.pmod("event_id", F.lit(4)) == k), ["event_type"], F.col("v")) for k in range(4)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = upkeep.quantiles(whole, ["event_type"], shares).collect()
    assert _rows(upkeep.quantiles(merged, ["event_type"], shares)) == sorted(map(tuple, got), key=str)
    for r in got:
        for name in shares:
            assert r[name] <= exact[r["event_type"]][name] < r[name] * (1 + 1 / 127) + 1


def test_bucket_edges(spark):
    values = [0, 1, -1, 127, 128, 255, 256, 257, 1023, -1023, 2**62 + 12345, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(upkeep.bucket_edge(F.col("v"))).collect()]
    plain = lambda v: 0 if v == 0 else (v // abs(v)) * (abs(v) >> max(0, abs(v).bit_length() - 8) << max(0, abs(v).bit_length() - 8))
    assert got == [None if v is None else plain(v) for v in values]
