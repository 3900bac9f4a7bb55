"""Functions without SQL of their own, against plain Python, and edge cases of the operators."""

from __future__ import annotations

import difflib
import importlib
import random
import re
import sys

from pyspark.sql import functions as F

from veldgraph.functions import parsers, pii, text
from veldgraph.operators import aggregates, filters, graph, joins, sinks, vector


def _packed(parts: list[str], most: int, joint: str = "") -> list[str]:
    done, now = [], ""
    for p in parts:
        if now == "" or len(now) + len(joint) + len(p) <= most:
            now = p if now == "" else now + joint + p
        else:
            done.append(now)
            now = p
    return [*done, now] if now else done


def test_sentences_and_packing(spark):
    texts = ["One. Two! Three? tail", "", "...start. a", "no end", "A.B.C." * 50]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("t", text.sentences(F.col("t")).alias("s"), text.packed(text.sentences(F.col("t")), 20).alias("p")).collect():
        found = re.findall(r"[^.!?]+[.!?]+", r["t"])
        assert r["s"] == found
        assert r["p"] == _packed(found, 20)


def test_amounts_of_the_fixture():
    said = {"1억 5만원": 100_050_000, "5천만원": 50_000_000, "5천원": 5000, "1,000만원": 10_000_000, "1억 5백만원": 105_000_000, "500원": 500, "1억 5천만원": 150_000_000}
    for text_, value in said.items():
        assert parsers.amounts(text_)[0][0] == value
    assert [a[0] for a in parsers.amounts("일반암은 1억원, 소액암은 1천만원, 고액암은 2억원입니다.")] == [100_000_000, 10_000_000, 200_000_000]


def test_legal_structure():
    rows = parsers.legal_structure("제10조 [암진단급여금 지급]\n① 가 ② 다만, 나 ③ 다")
    assert [(a, n, e) for a, _, n, _, e in rows] == [(10, 1, False), (10, 2, True), (10, 3, False)]
    assert parsers.legal_structure("") == []


def test_html():
    page = "<html><script>x()</script><p>a  b</p><a href='/x.pdf'>file</a><table><tr><td>1</td><td>2</td></tr></table>"
    assert parsers.html_text(page) == [("a\nb\nfile\n1\n2",)]
    assert parsers.html_links(page) == [("/x.pdf", "file")]
    assert parsers.html_tables(page) == [(0, "1\t2")]


def test_ratio_and_diff():
    assert parsers.ratio("abcd", "bcde") == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()
    assert parsers.line_diff("a\nb", "a\nc\nd") == (2, 1, 1.0)


def test_index_percentiles_match_arrays(spark):
    rows = spark.createDataFrame([(i % 3, float(i * 7 % 11)) for i in range(50)] + [(0, None)], "g int, v double")
    shares = {"p50": 0.5, "p95": 0.95}
    a = {r["g"]: (r["p50"], r["p95"]) for r in aggregates.index_percentiles(rows, ["g"], "v", shares).collect()}
    for g in range(3):
        values = sorted(float(i * 7 % 11) for i in range(50) if i % 3 == g)
        assert a[g] == tuple(values[int(len(values) * s)] for s in shares.values())


def test_band_join_at_its_edges(spark):
    a, b = spark.createDataFrame([(1, 0), (1, 100), (2, 5)], "g int, p int"), spark.createDataFrame([(1, 100), (1, 201), (2, 5)], "g int, q int")
    assert sorted(map(tuple, joins.band(a, b, ["g"], "p", "q", 100).select("g", "p", "q").collect())) == [(1, 0, 100), (1, 100, 100), (2, 5, 5)]


def test_shortest_path_prefers_the_least(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "d", "x"), ("a", "c", "x"), ("c", "d", "x"), ("e", "f", "x")], "src string, dst string, rel_type string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "f"), ("a", "a")], "start string, goal string")
    assert {(r["start"], r["goal"]): r["nodes"] for r in graph.shortest_paths(edges, pairs, 3).collect()} == {("a", "d"): ["a", "b", "d"], ("a", "a"): ["a"]}


def test_paths_use_no_edge_twice(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "a", "y")], "src string, dst string, rel_type string")
    found = graph.paths(edges, spark.createDataFrame([("a",)], "start string"), 5)
    assert sorted(">".join(r["nodes"]) for r in found.collect()) == ["a>b", "a>b>a"]


def test_top_k_each_is_exact(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(99, None)], "vec_id long, embedding array<double>")
    q = rows.filter("vec_id in (3, 10)")
    got = vector.top_k_each(rows, q, 4, block=1)
    for query in (3, 10):
        own = list(rows.filter(f"vec_id = {query}").first()["embedding"])
        best = [r["vec_id"] for r in vector.top_k(rows.filter("embedding is not null"), own, 4).orderBy(F.desc("score"), "vec_id").collect()]
        assert [r["id"] for r in got.filter(f"query_id = {query}").orderBy("rank").collect()] == best


def test_merges(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], [F.asc("v")]).collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(r["k"] for r in sinks.insert_missing(old, new, ["k"]).collect()) == [1, 2, 3]


def test_filters_without_conditions(spark):
    rows = spark.createDataFrame([(1, "a_b"), (2, None)], "k int, v string")
    assert rows.filter(filters.all_of(None, None)).count() == 2
    assert [r["k"] for r in rows.filter(filters.contains_any("_", "v")).collect()] == [1]


def test_a_chain_is_walked_to_any_depth(spark):
    """Twelve steps: each is stored, so plans don't grow with the square of the depth."""
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", "x") for i in range(14)], "src string, dst string, rel_type string")
    start = spark.createDataFrame([("n00",)], "start string")
    assert {(r["end"], r["depth"]) for r in graph.reachable(edges, start, 12).collect()} == {(f"n{i:02d}", i) for i in range(13)}
    assert graph.shortest_paths(edges, start.selectExpr("start", "'n12' AS goal"), 12).first()["nodes"] == [f"n{i:02d}" for i in range(13)]
    assert graph.paths(edges, start, 12, least=12).count() == 1


def test_similar_documents_match_all_pairs(spark):
    """Asked documents against all of their group, by all pairs."""
    words = [f"word{i}" for i in range(60)]
    docs = [(i, " ".join(words[(i % 4) * 7 :] + words[: i % 4] + [f"own{i}"]), "ab"[i % 2]) for i in range(20)] + [(50, "something else entirely", "a"), (60, "", "a")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = parsers.compared(text.sketch_candidates(rows, "doc_id", "source", F.col("doc_id") % 10 == 0), ["doc_id", "other_id"], "text", "other").filter("ratio >= 0.5")
    want = {(a, b): round(parsers.ratio(x, y), 6) for a, x, s in docs for b, y, s2 in docs if a % 10 == 0 and a != b and s == s2 and parsers.ratio(x, y) >= 0.5}
    assert {(r["doc_id"], r["other_id"]): r["ratio"] for r in found.collect()} == want
    assert len(want) == 8


def test_line_changes_keep_the_order_of_lines(spark):
    """A line that moves is removed and added; else as many lines as a plain longest common subsequence leaves."""
    rng = random.Random(4)
    some = lambda: "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
    cases = [("a\nb\nc", "b\nc\na"), ("", "a"), ("a", ""), (None, "a\n"), *((some(), some()) for _ in range(80))]

    def plain(a: list[str], b: list[str]) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *row[1:]]
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "id long, a string, b string")
    got = {r["id"]: (r["added"], r["removed"]) for r in parsers.line_changes(rows, "id", "a", "b").collect()}
    lines = [[x.split("\n") if x else [] for x in c] for c in cases]
    assert got == {i: (len(b) - plain(a, b), len(a) - plain(a, b)) for i, (a, b) in enumerate(lines)}
    assert got[0] == (1, 1)


def test_ratios_from_a_least_one_on(spark, monkeypatch):
    """The same ratios as without the bound; texts that have little in common are given up after a few of their blocks."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [said(n) for n in (0, 3, 30, 60, 400)]
    texts = [*base, *(" ".join(w for w in b.split() if rng.random() < keep) for b in base for keep in (0.9, 0.6, 0.4)), None]
    rows = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "i int, j int, a string, b string")
    got = {(r["i"], r["j"]): r["ratio"] for r in parsers.alike(rows, ["i", "j"], "a", "b", 0.5).collect()}
    every = {(i, j): round(parsers.ratio(a or "", b or ""), 6) for i, a in enumerate(texts) for j, b in enumerate(texts)}
    assert got == {k: v for k, v in every.items() if v >= 0.5}
    calls = []
    find = parsers.difflib.SequenceMatcher.find_longest_match
    monkeypatch.setattr(parsers.difflib.SequenceMatcher, "find_longest_match", lambda self, *a: calls.append(a) or find(self, *a))
    far = parsers.difflib.SequenceMatcher(None, *["".join(chr(rng.randint(0x4E00, 0x4E80)) for _ in range(3000)) for _ in range(2)])
    assert parsers.ratio_from(far, 0.5) is None
    short = len(calls)
    assert far.ratio() < 0.5
    assert short * 5 < len(calls) - short


def test_personal_data_of_the_fixture(spark):
    cases = [
        ("Contact us at support@example.com or admin@mail.example", {"email": 2}), ("Call me at 010-1234-5678 or 01098765432", {"phone": 2}), ("My SSN is 900101-1234567", {"ssn": 1}), ("Card: 1234-5678-9012-3456", {"credit_card": 1}), ("010 1234 5678", {"phone": 1}),
        ("Server IP: 192.168.1.100", {"ip_address": 1}), ("This is a safe text without any PII", {}), ("", {}),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", pii.detected(F.col("t")).alias("x"), pii.contains_pii(F.col("t")).alias("any"))
    for r in rows.collect():
        want = cases[r["i"]][1]
        assert want.items() <= {k: len(v) for k, v in r["x"].items()}.items()
        assert r["any"] == bool(want)


def test_entry_works_without_the_llm_subpackage():
    kept = {k: m for k, m in sys.modules.items() if k.startswith(("veldgraph.llm", "corpus_pipeline", "__spark_entry__"))}
    for k in kept:
        del sys.modules[k]
    blocked = {"veldgraph.llm": None, "corpus_pipeline": None}
    sys.modules.update(blocked)
    try:
        entry = importlib.import_module("__spark_entry__")
        names = entry.queries()
        assert "v_topk" in names and not any(n.startswith("op") for n in names)
        assert entry.oracle_sql().keys() <= names.keys()
    finally:
        for k in [*blocked, "__spark_entry__"]:
            sys.modules.pop(k, None)
        sys.modules.update(kept)
