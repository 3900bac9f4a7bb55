"""The cost of questions: a score is computed once, and no pattern walks through a text without its ending."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldgraph.functions import nlq


def test_scores_once_and_the_same(spark):
    rows = spark.createDataFrame([("보장 금액은 얼마인가요",), ("대기기간은 언제부터",), ("Hello",), ("",), (None,), ("면책 제외",), ("보장",)], "q string")
    got = rows.select("q", nlq.best_intent(F.col("q")).alias("one"), F.get(nlq.intent_scores(F.col("q")), F.lit(0)).alias("first"))
    for r in got.collect():
        assert r["one"] == (r["first"]["intent"] if (r["first"]["score"] or 0) >= nlq.LEAST_SCORE else "unknown")
    plan = rows.select(nlq.best_intent(F.col("q")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") == len(nlq.INTENTS)


def test_endings_first(spark):
    rows = spark.createDataFrame([("갑상선암과 폐암, 뇌출혈 그리고 갑상선암",), ("hello",), (None,), ("암",), ("골절보장과 수술특약",)], "q string")
    got = [(r["d"], r["c"]) for r in rows.select(nlq.diseases(F.col("q")).alias("d"), nlq.coverages(F.col("q")).alias("c")).collect()]
    assert got == [(["갑상선암"], []), ([], []), (None, None), ([], []), ([], ["골절보장", "수술특약"])]
