"""What made work grow faster than its input is gone, with the same results."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from veldgraph.operators import cascade, extractions, fuzzy, text_index, vector
from veldgraph.plans import Tables, search, streams
from veldgraph.storage import scratch_path

SF = "/root/testdata/sf0.001"


def test_exact_links_compare_no_names(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "similar", lambda *a: 1 / 0)
    assert {r["stage"] for r in search.QUERIES["jn_dim_exact"](spark, SF).select("stage").distinct().collect()} == {"exact", "other"}


def test_stand_ins_are_digests(spark):
    texts = ["a", "", "같다", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 200)], "id long, t string")
    got = {r["id"]: list(r["v"]) for r in rows.select("id", vector.stand_in(F.col("t"), 12).alias("v")).collect()}
    want = lambda t: [None] * 12 if t is None else [(int(hashlib.md5(f"{t}:{i}".encode()).hexdigest()[:8], 16) - 2147483648) / 2147483648.0 for i in range(12)]
    assert got == {i: want(t) for i, t in enumerate(texts * 200)}
    plan = rows.select(vector.stand_in(F.col("t"), 12).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan


def test_slices_have_several_files(spark, monkeypatch):
    monkeypatch.setattr(streams, "SLICED", 50)
    t = Tables(spark, SF)
    n = t.events.count()
    found = streams._slices(t)
    files = list(Path(found._jdf.queryExecution().analyzed().toString().split("file:")[1].split("]")[0].split(",")[0]).glob("*.parquet")) if "file:" in found._jdf.queryExecution().analyzed().toString() else None
    assert files is None or len(files) == 5 * -(-n // 250)
    got = streams.QUERIES["st_rate_limit_stream"](spark, SF)
    monkeypatch.undo()
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, streams.QUERIES["st_rate_limit_stream"](spark, SF).collect()))


def test_nodes_are_made_distinct_by_number_of_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", "제1조(가) C10 1억원\n① C10\n② 1억원") for i in range(40)] * 2, "policy string, text string")
    want = Counter(map(tuple, extractions.clause_graph(docs, "policy", "text").collect()))
    assert max(want.values()) == 1
    monkeypatch.setattr(extractions, "DEALT", 4)
    found = extractions.clause_graph(docs, "policy", "text")
    assert Counter(map(tuple, found.collect())) == want
    assert found.rdd.getNumPartitions() == 20


def test_an_index_is_written_without_a_shuffle_of_postings(spark, monkeypatch):
    """Also in runs of few words, with rows that repeat an id, and counted from the postings' terms."""
    docs = spark.createDataFrame([(1, "b a b", "x"), (2, "", "a"), (3, None, None), (4, "c " * 50 + "a", "b"), (1, "a", "x x"), (None, "a", "a")], "id long, t string, u string")
    want = {("a", 1, 2.0, (0, 1)), ("b", 1, 2.0, (0, 2)), ("x", 1, 1.5, (text_index.GAP,) * 2 + (text_index.GAP + 1,)), ("a", 2, 0.5, (text_index.GAP,)), ("c", 4, 50.0, tuple(range(50))), ("a", 4, 1.0, (50,)), ("b", 4, 0.5, (text_index.GAP,))}
    weights = {"t": 1.0, "u": 0.5}
    for words in (text_index.WORDS, 1, 4):
        monkeypatch.setattr(text_index, "WORDS", words)
        index = text_index.written(docs, scratch_path(spark, "words"), "id", weights, buckets=3)
        got = index.postings(["a", "b", "c", "x"])
        assert {(r["term"], r["id"], r["weight"], tuple(r["places"])) for r in got.collect()} == want and got.count() == len(want)
        assert index.counts(["a", "c", "none"]) == {"a": 3, "c": 1, "none": 0}
    plan = text_index._postings(docs, weights)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_walks_shuffle_no_edges(spark):
    """Edges lie in buckets of their source, as nodes do, and join where they are."""
    edges = spark.range(500).select(F.concat(F.lit("a"), F.col("id") % 50).alias("src"), F.concat(F.lit("b"), F.col("id") % 7).alias("dst"), "id")
    nodes = spark.range(20).select(F.concat(F.lit("a"), "id").alias("node_id")).distinct()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = cascade.by_source(edges).join(cascade._bucketed(nodes, "node_id").withColumnRenamed("node_id", "src"), "src", "left_semi")
        assert met.count() == 200
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_edges_that_stay_have_both_ends(spark):
    """By an anti join of each end: copies, missing ends, roots that others refer to."""
    rng = random.Random(3)
    ends = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)]
    edges = [*ends, *ends[:9], (None, "n1"), (None, "n2"), (None, "r"), ("n1", None), ("r", None), ("n3", "r"), ("x", "r"), ("r", "only"), ("only", "more"), (None, "more"), (None, "y"), (None, None)]
    roots = [("r",), ("n4",), ("n5",), (None,), ("r",)]
    frame = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, w int")
    gone = {r[0] for r in cascade.doomed(frame, spark.createDataFrame(roots, "node_id string")).collect()}
    assert {"r", "only", "more", "n4", "n5"} <= gone
    nodes, kept = cascade.deleted(frame.select(F.col("dst").alias("node_id")), frame, spark.createDataFrame(roots, "node_id string"))
    assert sorted(r["w"] for r in kept.collect()) == [i for i, (a, b) in enumerate(edges) if a not in gone and b not in gone]
    assert Counter(r[0] for r in nodes.collect()) == Counter(b for _, b in edges if b not in gone)


def test_few_pairs_are_compared_exactly_and_in_many_tasks(spark, monkeypatch):
    """Names with common grams that are too far apart are left out before the exact ratio; names of few bytes are dealt to all tasks."""
    compared, written = [], {}
    ratios, stored = fuzzy._ratios, fuzzy.stored
    monkeypatch.setattr(fuzzy, "_ratios", lambda pairs, threshold: (compared.append(pairs), ratios(pairs, threshold))[1])
    monkeypatch.setattr(fuzzy, "stored", lambda df, name: written.setdefault(name, stored(df.withColumn("task", F.spark_partition_id()), name)).drop("task"))
    rng = random.Random(5)
    names = ["".join(rng.choice(["tion", "ing", "er", "and"]) for _ in range(4)) for _ in range(150)]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    found = fuzzy.similar(frame, frame, "n", "n").count()
    distinct = len(set(names))
    assert found >= distinct
    assert compared[0].count() <= 2 * found < distinct**2 / 4
    assert written["named"].select("task").distinct().count() == 4
