"""Checks of the stages of ingestion, and routes of reading, by cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veldgraph.functions import checks, text

SOUND = {
    "total_chars": 500, "articles": 3, "paragraphs": 4, "subclauses": 1, "empty_articles": 0, "long_articles": 0, "duplicate_articles": 0, "entities": 2,
    "embeddings": 8, "dim": 1536, "nodes": 11, "article_nodes": 3, "policy_nodes": 1, "structural_nodes": 8,
}
PARSED = ["articles", "paragraphs", "subclauses", "empty_articles", "long_articles", "duplicate_articles"]
GRAPH = ["nodes", "article_nodes", "policy_nodes", "structural_nodes"]


@pytest.mark.parametrize(
    ("changed", "want"),
    [
        ({}, (14, 14, True, [])),
        ({"nodes": 12, "embeddings": 7, "dim": 64, "article_nodes": 2}, (14, 10, False, ["nodes differ", "embeddings differ", "dimension differs", "article nodes differ"])),
        ({"total_chars": 99, "empty_articles": 1, "long_articles": 2, "duplicate_articles": 1}, (14, 10, False, ["short text", "empty articles", "long articles", "repeated articles"])),
        ({"embeddings": 0, "dim": None}, (14, 12, True, ["no embeddings", "embeddings differ"])),
        ({"policy_nodes": 0, "structural_nodes": 0}, (14, 12, False, ["policy nodes", "no structure"])),
        ({"entities": None}, (10, 9, True, ["no extraction"])),
        (dict.fromkeys(PARSED), (7, 6, False, ["not parsed"])),
        (dict.fromkeys(SOUND), (5, 0, False, ["no text", "not parsed", "no extraction", "no embeddings", "no nodes"])),
        (dict.fromkeys(GRAPH), (8, 7, False, ["no nodes"])),
    ],
)
def test_stages(spark, changed, want):  # noqa: ANN001
    row = SOUND | changed
    names = [part.split()[0] for part in checks.STAGES.split(",")]
    df = spark.createDataFrame([tuple(row[n] for n in names)], checks.STAGES)
    r = df.select(checks.pipeline_report().alias("r")).first()["r"]
    assert (r["checks"], r["passed"], r["ok"], [i["issue"] for i in r["issues"]]) == want


def test_routes(spark):  # noqa: ANN001
    mb = 1024 * 1024
    sizes = spark.createDataFrame([(10 * mb - 1,), (10 * mb,), (10 * mb + 1,)], "n long").select(text.read_route(F.col("n")).alias("r")).collect()
    assert [tuple(r["r"]) for r in sizes] == [("memory", 1), ("stream", 10), ("stream", 11)]
    rows = [("progressive", 1, "제1조" * 50, "simple"), ("progressive", 1, "plain", "ocr"), ("smart", 1, "", "ocr"), ("smart", 1, "a!!b", "ocr"), ("smart", 1, "ab\ncd", "simple"), ("simple", 5 * mb, "", "simple"), ("simple", 5 * mb + 1, "", "ocr"), ("ml", 1, "", "ocr")]
    found = spark.createDataFrame(rows, "strategy string, n long, body string, want string").select(text.extraction_route(F.col("strategy"), F.col("n"), F.col("body")).alias("got"), "want").collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]
