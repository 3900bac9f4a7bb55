"""The corpus pipeline against plain versions of its stages."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import _fixture
from veldgraph.llm import decontaminate, queries


def _domain(source: str) -> str:
    digits = "".join(c for c in source if c.isdigit())[-6:]
    return f"d{int(digits) % 4}" if digits else "d0"


def _tables(spark, tmp_path) -> tuple[list[tuple], list[tuple], str]:  # noqa: ANN001
    rng = random.Random(11)
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in _fixture()]
    passage = " ".join("".join(rng.choice("mnopq") for _ in range(5)) for _ in range(24))
    half = passage.split()
    rows += [(100, f"before {passage} after", "en", "src1", 9), (101, f"{' '.join(half[12:])} then something quite different stands here {' '.join(half[:12])}", "en", "src2", 9), (102, "12345 !!", "en", "src3", 8)]
    items = [(0, passage)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items, str(tmp_path)


def test_run_matches_brute_force(spark, tmp_path):
    rows, items, folder = _tables(spark, tmp_path)
    got = {r["doc_id"]: (r["text"], r["n_epochs"]) for r in corpus_pipeline.run(spark, folder).collect()}
    known = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    parts = brute.components([(r[0], r[1]) for r in known])
    known = [r for r in known if parts[r[0]][1] == r[0]]
    gone = {x[0] for x in brute.contaminated([(r[0], r[1]) for r in known], items, decontaminate.MATCH, decontaminate.COVERAGE)}
    assert gone == {100, 101}
    known = [r for r in known if r[0] not in gone]
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets_stage(spark, spark.createDataFrame(known, "doc_id long, text string, lang string, source string, n_chars long"), folder).collect()}
    assert not any(brute.base_spans(t) for t in clean.values())
    tree = [(r[0], len(brute.WORD.findall(clean[r[0]])), (_domain(r[3]), r[2] or "(null)", r[3])) for r in known]
    want = brute.mixture(tree, [queries.DOMAIN_WEIGHTS, queries.LANGUAGE_WEIGHTS, {}], queries.MIXED_PERCENT, queries.EPOCHS, queries.SEED)
    assert got == {d: (clean[d], n) for d, n in want.items()}


def test_stages_keep_the_columns(spark, tmp_path):
    _, _, folder = _tables(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_stages_of_an_empty_table(spark, tmp_path):
    _, _, folder = _tables(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_rows_without_an_id_and_with_one_id(spark, tmp_path):
    """Null ids stay through near duplicates and are judged by their text in decontamination; rows of one id are one document to the first and two to the second."""
    rows, items, folder = _tables(spark, tmp_path)
    passage = items[0][1]
    odd = [(None, "some text without an id"), (None, "some text without an id"), (None, f"x {passage}"), (7, "first text of seven here"), (7, f"second text of seven: {passage}"), (7, "first text of seven here"), (8, "first text of seven here")]
    docs = spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_stage(spark, docs, folder).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, odd[:6]))
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination_stage(spark, docs, folder).collect()]
    assert sorted(map(str, clean)) == sorted(map(str, [x for x in odd if passage not in x[1]]))
