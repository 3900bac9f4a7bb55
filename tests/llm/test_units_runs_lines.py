"""Fill-in-the-middle cuts, periodic runs and line deduplication against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connection, difference
from tests.llm import brute
from veldgraph.llm import fill_in_middle, line_dedup, periodic_runs, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n long, place int, runs string, n_lines long, id string, cut_0 int, bitmap string"


def _frame(spark, rows):  # noqa: ANN001, ANN202
    return spark.createDataFrame([(i, t, "en", 1, 2, "r", 3, "x", 4, "b") for i, t in rows], SCHEMA)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def _texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(11)
    texts = [None, "", "a", "ab", "<P> inside", "x<S", "<<M", "😀" * 200, "é日本\n\n語 " * 40, " lead and  gaps\t", "\n\n\n", "long " * 9000]
    texts += ["".join(rng.choice("ab <\n>PSMé😀") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    rows: list[tuple[int | None, str | None]] = [(7 * i, t) for i, t in enumerate(texts)]
    # Null ids, one id with two texts, equal rows.
    return [*rows, (None, "no id, but text"), (None, None), (14, "another text of document 14"), (21, "ab"), (21, "ab")]


@pytest.mark.parametrize("unit", ["CHARACTER", "WORD", "LINE"])
def test_cuts_match_brute_force(spark, unit):
    pattern = getattr(fill_in_middle, unit)
    got = fill_in_middle.fill_in_middle(_frame(spark, _texts()), pattern).withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(i), *brute.filled(i, t, re.compile(pattern))) for i, t in _texts())
    assert sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == sorted(want)
    assert sorted(r["again"] for r in got) == sorted(t or "" for _, t in _texts())
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_cuts_of_an_empty_table(spark):
    assert fill_in_middle.fill_in_middle(_frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_line_dedup"])
def test_query_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connection(SF), queries.ORACLES[name]) == ""


def test_texts_are_shuffled_once(spark, capsys):
    fill_in_middle.fill_in_middle(spark.read.parquet(f"{SF}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 3  # the same text exchange twice, and the requests


# 12


def _sequences() -> list[list[str]]:
    rng = random.Random(12)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 7, list("abababab"), list("abababa"), list("xabcabcabcabcy"), list("aabaabaabaab") * 3, ["w"] * 500, list("ab" * 40 + "c" + "ab" * 40)]
    for _ in range(150):
        words = [rng.choice("ab") for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            at, p = rng.randrange(len(words)), rng.randint(1, 9)
            piece = [rng.choice("abc") for _ in range(p)]
            words[at:at] = (piece * rng.randint(2, 7))[: rng.randint(p, 7 * p)]
        out.append(words)
    return out


def test_runs_match_the_definition():
    for words in _sequences():
        numbers: dict[str, int] = {}
        found = periodic_runs.runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32))
        assert found == brute.periodic(words), words


def test_runs_without_the_kept_grid(monkeypatch):
    monkeypatch.setattr(periodic_runs, "KEPT_GRID", 8)
    test_runs_match_the_definition()


def test_extensions_match_plain_comparison():
    rng = np.random.default_rng(4)
    for n in (6, 17, 64, 200):
        words = rng.integers(0, 2, n).astype(np.int32)
        i, j = rng.integers(0, n + 1, 300), rng.integers(0, n + 1, 300)
        i, j = i[i != j], j[i != j]
        plain = [next((k for k in range(n) if max(a, b) + k >= n or words[a + k] != words[b + k]), n) for a, b in zip(i, j, strict=True)]
        assert periodic_runs.Extensions(words).of(i, j).tolist() == plain


def test_runs_of_a_long_text(spark):
    """A run of 40,000 words of period 1,500 in a text of 70,000 words, beyond the kept grid, and a word of 100,000 characters."""
    head = [f"h{i}" for i in range(20000)]
    body = [f"b{i % 1500}" for i in range(40000)]
    tail = [f"t{i}" for i in range(10000)] + ["z" * 100000]
    row = periodic_runs.periodic_runs(_frame(spark, [(1, " ".join(head + body + tail))]), "doc_id").first()
    assert [tuple(r) for r in row["runs"]] == [(20000, 40000, 1500)]
    assert row["collapsed"] == " ".join(head + body[:1500] + tail)


def test_run_rows_match_brute_force(spark, monkeypatch, tmp_path):
    texts: list[tuple[int | None, str | None]] = [(i, " ".join(w)) for i, w in enumerate(_sequences())]
    rng = random.Random(3)
    texts += [(1000 + i, "\n ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 90)))) for i in range(200)]
    texts += [(None, "a a a a a a a"), (None, None), (5000, None), (5001, " \t\n"), (5002, "é é é é é é é é"), (3, "b b b b b b"), (3, "b b b b b b")]
    monkeypatch.setattr(queries, "load", lambda spark, sf_dir, table: _frame(spark, texts))
    got = queries.op12_periodic_runs(spark, "").collect()
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [(str(i), *brute.run_row(brute.planted(i, t))) for i, t in texts]
    assert sorted(map(repr, want)) == sorted(repr((str(r["doc_id"]), *[r[c] for c in names])) for r in got)
    assert sum(r["n_runs"] > 0 for r in got) > 40


def test_planted_runs_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in queries.with_planted_run(docs).collect()}
    assert {i: brute.WORD.findall(t or "") for i, t in got.items()} == {r["doc_id"]: brute.planted(r["doc_id"], r["text"]) for r in docs.collect()}


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.periodic_runs(_frame(spark, []), "doc_id", "lang").count() == 0


def test_best_run_takes_ties_by_start(spark):
    runs = spark.createDataFrame([([(0, 8, 2), (9, 12, 3), (30, 9, 2)],), ([(5, 8, 2), (20, 12, 3)],), ([],)], f"runs {periodic_runs.RUNS}")
    best = [r["b"] and tuple(r["b"]) for r in runs.select(periodic_runs.best_run(F.col("runs")).alias("b")).collect()]
    assert best == [(30, 9, 2), (5, 8, 2), None]


# 13


def _lined(n: int, seed: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    shared = [f"{'common line of the test '}{i} {'x' * i}" for i in range(8)]
    hot = "This Line Is In Nearly Every Document"
    rows: list[tuple[int | None, str | None]] = []
    for i in range(n):
        lines = [rng.choice([rng.choice(shared), hot, hot.upper() + " \t", f"only line of document number {i}", "short", "", " \x0b" + rng.choice(shared)]) for _ in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(lines)))
    rows += [(None, hot), (None, None), (n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "a" * 30000 + "\n" + hot), (5, hot + "\nother text of document 5, once"), (6, rows[6][1])]
    rows += [(n + 4, "twice in two documents only\ntwice in two documents only"), (n + 5, "twice in two documents only")]
    return rows


@pytest.mark.parametrize(("ranges", "batch"), [(None, 10000), (1, 3), (7, 10000), (40, 5), (200, 1)])
def test_lines_match_brute_force(spark, ranges, batch):
    rows = _lined(150, 13)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = line_dedup.line_dedup(_frame(spark, rows), ranges=ranges)
        assert {"lang", "n", "place", "runs", "id", "cut_0", "bitmap"} <= set(got.columns)
        found = sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"])) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert found == sorted(map(repr, brute.without_lines(rows, 20, 3)))


def test_a_hot_line_is_spread(spark):
    """One line in every document: its rows fill all ranges, and the result doesn't change."""
    rows = [(i, "one line that every document holds\nown text of document " + str(i)) for i in range(3000)]
    lines = line_dedup.lines(_frame(spark, rows).repartition(8))
    parts = line_dedup.streamed(lines, ranges=16).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 7 and max(r["count"] for r in parts) < 1000
    out = line_dedup.line_dedup(_frame(spark, rows), ranges=16).filter("n_dropped = 0").collect()
    assert [r["doc_id"] for r in out] == [2999]


def test_bitmaps_are_short(spark):
    rows = [(i, "\n".join(["a line that three documents hold", *[f"line {k} of document {i}, its own" for k in range(5000)]])) for i in range(3)]
    maps = line_dedup.keep_bitmaps(_frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in maps) == [0, 1]
    assert all(r["n_dropped"] == 1 and zlib.decompress(r["bitmap"]) == b"\x7f" for r in maps)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.line_dedup(_frame(spark, [])).count() == 0
