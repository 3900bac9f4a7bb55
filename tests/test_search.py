"""The inverted index against scans, and links of alike names against all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from veldgraph.operators import filters, fuzzy, joins, text_index
from veldgraph.plans.search import _words
from veldgraph.storage import load, scratch_path

SF = "/root/testdata/sf0.001"


def test_index_equals_scan(spark):
    docs = load(spark, SF, "documents").unionByName(spark.createDataFrame([(-1, None, "en", "x", 0), (-2, "", None, None, 0), (-3, "The the THE-of the", "of", None, 3)], "doc_id long, text string, lang string, source string, n_chars long"))
    weights = {"text": 1.0, "lang": 0.2}
    index = text_index.written(docs, scratch_path(spark, "words"), "doc_id", weights, buckets=5)
    for query in ("the", "of THE", "the of and", "nowhere the", "", "...", "en of"):
        want = {tuple(r) for r in filters.full_text(docs, " ".join(query.replace(".", "").split()), weights).select("doc_id", "rank").collect()} if query.strip(". ") else set()
        assert {tuple(r) for r in text_index.search(index, query).collect()} == want, query


def test_phrases(spark):
    rows = spark.createDataFrame([(1, "a b c", "d"), (2, "b a", "c"), (3, "a x b c a b", "z"), (4, "c", "a b"), (5, "a a", "b"), (6, "a a b", "")], "id long, t string, u string")
    index = text_index.written(rows, scratch_path(spark, "words"), "id", {"t": 1.0, "u": 0.5})
    hits = lambda q: sorted(r["id"] for r in text_index.search(index, q, phrase=True).collect())
    assert hits("a b") == [1, 3, 4, 6]
    assert hits("a a b") == [6]
    assert hits("a b c") == [1]
    assert hits("c a") == [3]
    assert hits("c d") == []  # no phrase spans two fields


def test_long_postings_are_not_shuffled(spark, monkeypatch):
    """Where the rarest term has few documents only they are sent; beyond the bound the result is the same."""
    docs = load(spark, SF, "documents")
    index = text_index.written(docs, scratch_path(spark, "words"), "doc_id", {"text": 1.0})
    few = text_index.search(index, "the of")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "PartitionFilters" in plan
    monkeypatch.setattr(text_index, "SENT", 0)
    assert sorted(map(tuple, text_index.search(index, "the of").collect())) == sorted(map(tuple, few.collect()))


def _all_pairs(queries, names, threshold):  # noqa: ANN001, ANN202
    queries, names = {q.lower() for q in queries if q}, {n.lower() for n in names if n}
    out = set()
    for n in names:
        m = SequenceMatcher(None)
        m.set_seq2(n)
        for q in queries:
            m.set_seq1(q)
            if m.real_quick_ratio() >= threshold and m.ratio() >= threshold:
                out.add((q, n))
    return out


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_no_link_is_lost(spark, threshold):
    """Short random names over few letters, so that many pairs are at the threshold."""
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
    queries, names = [name() for _ in range(150)] + [None, "", "ABC"], [name() for _ in range(150)] + ["x" * 300, None]
    frame = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = fuzzy.similar(frame(queries, "q"), frame(names, "n"), "q", "n", threshold)
    assert {(r["query"], r["name"]) for r in got.collect()} == _all_pairs(queries, names, threshold)


def test_links_of_the_tables(spark):
    queries = [r[0] for r in _words(load(spark, SF, "conversations")).collect()]
    names = [r[0] for r in _words(load(spark, SF, "benchmark")).collect()]
    got = fuzzy.similar(_words(load(spark, SF, "conversations")), _words(load(spark, SF, "benchmark")), "word", "word")
    some = {q for q in queries if len(q) % 3 == 0}
    assert {(r["query"], r["name"]) for r in got.collect() if r["query"] in {s.lower() for s in some}} == _all_pairs(some, names, 0.8)


def test_stages_of_a_link(spark):
    names = spark.createDataFrame([("Thyroid cancer", 1, "C73"), ("stroke", 2, None), ("liver cancer", 3, "C22")], "name string, value long, code string")
    rows = [("THYROID CANCER",), ("see C22 please",), ("strokee",), ("livr cancer",), ("C99",), (None,), ("strokee",)]
    got = fuzzy.linked(spark.createDataFrame(rows, "q string"), names, "q", "name", "value", "code").collect()
    assert sorted((str(r["q"]), r["value"], r["match_method"]) for r in got) == sorted(
        [("THYROID CANCER", 1, "exact"), ("see C22 please", 3, "kcd"), ("strokee", 2, "fuzzy"), ("strokee", 2, "fuzzy"), ("livr cancer", 3, "fuzzy"), ("C99", None, "none"), ("None", None, "none")]
    )
    score = next(r["match_score"] for r in got if r["q"] == "strokee")
    assert score == SequenceMatcher(None, "strokee", "stroke").ratio()


def test_contained_labels_equal_all_pairs(spark):
    rng = random.Random(2)
    labels = [(i, "".join(rng.choice("abAB ") for _ in range(rng.randint(1, 9))), i % 3) for i in range(300)]
    got = joins.contained(spark.createDataFrame(labels, "id long, label string, g int"), "label", equal=("g",)).select("g", "inner", "outer").collect()
    names = {(g, x.lower()) for _, x, g in labels if len(x) >= 4}
    assert {tuple(r) for r in got} == {(g, a, b) for g, a in names for h, b in names if g == h and a != b and a in b}
    assert len(got) == len({tuple(r) for r in got}) > 20


def test_rows_with_contained_labels_equal_all_pairs(spark, monkeypatch):
    """All rows, copies of a label too, also where a key makes more pairs than a task should."""
    rng = random.Random(2)
    labels = [(i, "".join(rng.choice("abAB ") for _ in range(rng.randint(1, 7))), i % 3) for i in range(200)] + [(200 + i, "baba", 0) for i in range(9)] + [(300, None, 0), (301, "x", 1)]
    want = sorted((g, i, j) for i, a, g in labels for j, b, h in labels if g == h and i != j and a and b and len(a) > 3 and a.lower() in (b + " ba").lower())
    frame = spark.createDataFrame(labels, "id long, label string, g int")
    for made in (joins.MADE, 10):
        monkeypatch.setattr(joins, "MADE", made)
        got = joins.containing_rows(frame, "label", "id", ("g",), tail=" ba")
        assert sorted(tuple(r) for r in got.select("g", "id_1", "id_2").collect()) == want
    assert len(want) > 72


def test_pairs_of_a_key_are_dealt(spark, monkeypatch):
    """A key of many pairs goes to several tasks, with the same pairs."""
    rows = spark.createDataFrame([(i, i // 60) for i in range(80)], "id long, k int")
    want = {(i, j) for i in range(80) for j in range(80) if i < j and i // 60 == j // 60}
    monkeypatch.setattr(joins, "MADE", 100)
    got = joins.pairs(rows, ["k"], "id").select("id_1", "id_2", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["id_1"], r["id_2"]) for r in got) == sorted(want)
    assert len({r["task"] for r in got if r["id_1"] < 60}) > 5


def test_the_least_number_of_shared_grams_is_a_bound(spark):
    """For names of all lengths, the bound from a length on is at most the bound of each longer total."""
    for threshold in (0.7, 0.8, 0.9, 1.0):
        q = fuzzy.gram_size(threshold)
        rows = spark.range(2, 60).select("id", fuzzy._least(F.col("id"), threshold, q).alias("own"), fuzzy._least_from(F.col("id"), threshold, q).alias("low")).collect()
        for r in rows:
            assert all(r["low"] <= s["own"] for s in rows if s["id"] >= r["id"])
