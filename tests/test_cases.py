"""Single cases by hand: questions, answers, extraction, masks and formats. Queries over whole tables are held against SQL elsewhere."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veldgraph.functions import answers, checks, compliance, nlq, parsers, pii, responses, text
from veldgraph.sources import configs, ontology

QUESTIONS = [
    "갑상선암 보장 금액은 얼마인가요?", "간암은 보장되나요?", "갑상선암과 간암의 보장 차이는?", "대기기간은 언제부터 90일 인가요", "C73 코드와 I21.9 진단 시 1억원 이상 보장", "면책 제외 사항", "hello world C77", "약관 상품 요약", "3년 6개월 2주 수술 입원 암진단특약 5천만원 이하", "",
]


def _each(spark, values, use):  # noqa: ANN001, ANN202
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, q string")
    return [r["x"] for r in rows.select("i", use(F.col("q")).alias("x")).orderBy("i").collect()]


def test_questions(spark):
    assert _each(spark, QUESTIONS, nlq.simple_intent) == ["coverage_check", "coverage_check", "comparison", "period_check", "coverage_check", "exclusion_check", "search", "search", "amount_filter", "search"]
    named = lambda use: lambda q: use(nlq.best_intent(q), F.size(nlq.diseases(q)), F.size(nlq.coverages(q)))
    assert _each(spark, QUESTIONS, named(nlq.query_type)) == ["graph_traversal", "hybrid", "graph_traversal", "direct_lookup", "hybrid", "direct_lookup", "hybrid", "vector_search", "hybrid", "hybrid"]
    assert _each(spark, QUESTIONS, named(nlq.answerable)) == [True, False, True, True, False, False, False, True, False, False]
    assert _each(spark, QUESTIONS, nlq.kcd_codes)[4:7:2] == [["C73", "I21.9"], ["C77"]]
    assert _each(spark, QUESTIONS, nlq.periods)[8] == [1095, 180, 14]
    assert _each(spark, ["면책기간과 가입나이 및 계약일"], nlq.conditions) == [["면책기간@0", "가입나이@6", "계약일@13"]]
    assert _each(spark, ["C00-C97 , D05 및 C73은", "(I20-25)"], nlq.kcd_ranges) == [["C00-C97", "D05"], ["I20-I25"]]
    scored = _each(spark, ["간암 진단 시 얼마를 받나요?", "보장 안 되는 암은 무엇인가요?", "이 보험 상품 개요는?"], lambda q: F.concat_ws(" ", nlq.best_intent(q), F.get(nlq.intent_scores(q), F.lit(0))["score"]))
    assert scored == ["coverage_amount 0.32", "coverage_inquiry 0.53", "unknown 0.165"]


def test_masks(spark):
    cases = {
        "email": [("a@b.com", "a@b.com"), ("abc@b.com", "a**@b.com"), ("hong.gil@b.co.kr", "h******l@b.co.kr"), ("none", "none")],
        "phone": [("010-1234-5678", "010-****-5678"), ("0101234567", "010-****-4567"), ("123-456", "123-456"), ("02-345-6789", "02345****"), ("010 1234 5678", "010-****-5678")],
        "ssn": [("900101-1234567", "900101-1******"), ("9001", "9001")], "credit_card": [("1234-5678-9012-3456", "****-****-****-3456"), ("1234", "1234")],
        "bank_account": [("110-123-456789", "110-***-******789"), ("123-456", "123-***-456"), ("12", "12")], "ip_address": [("192.168.0.1", "192.168.***.***"), ("x", "x")],
    }
    for kind, rows in cases.items():
        assert _each(spark, [v for v, _ in rows], pii.MASKS[kind]) == [m for _, m in rows]
    assert _each(spark, ["홍길동", "John Doe"], pii.masked_name) == ["홍**", "J*** D**"]
    said = "call 010-1234-5678 or hong.gil@b.co.kr from 10.0.0.1 card 1234-5678-9012-3456 id 900101-1234567 acc 110-123-456789"
    assert _each(spark, [said], pii.masked_text) == ["call 010-****-5678 or h******l@b.co.kr from 10.0.***.*** card ****-****-****-3456 id 900101-1****** acc 110-123-456789"]
    assert _each(spark, ["../a b?.pdf", "약관.pdf"], pii.safe_filename) == ["a_b_.pdf", "약관.pdf"]


def test_extraction():
    assert [a[:1] + a[2:] for a in parsers.amounts("1억 5만원 그리고 1,000만원 및 1억 5백만원")] == [(100_050_000, "1억 5만원"), (50_000, "5만원"), (10_000_000, "1,000만원"), (105_000_000, "1억 5백만원"), (5_000_000, "5백만원")]
    assert [a[0] for a in parsers.amounts_by_span("1억 5만원 그리고 1,000만원 및 1억 5백만원")] == [100_050_000, 10_000_000]
    assert [p[0] for p in parsers.periods("3년 6개월 2주 1일")] == [1095, 180, 14, 1]
    assert [e[:2] for e in parsers.entities("자기부담금 10,000원, 암수술 특약, 만 15세 ~ 만 60세, 제12조")] == [("benefit_amount", "10,000원"), ("deductible", "10,000원"), ("rider", "암수술"), ("eligibility", "만 15세 ~ 만 60세"), ("article", "12")]
    assert [c[1:4] for c in parsers.semantic_chunks("머리말\n제1조 목적\n이 약관은\n제2장 지급\n제3조 사유\n끝")] == [("article", 0, 0), ("chapter", 1, 2), ("article", 3, 3), ("article", 4, 5)]
    blocks = ["제1조 " + "가" * 1300, "| a | b |", "제2조 " + "나" * 100, "제3조 " + "다" * 1600, "제4조 " + "라" * 50]
    assert [(t, n, len(b)) for _, t, n, b in parsers.structural_chunks("\n\n".join(blocks))] == [(False, 1, 1304), (True, 1, 9), (False, 3, 1765)]
    assert parsers.legal_lines("머리말 제1조(가) 안쪽\n본문") == [(0, "본문", "머리말 제1조(가) 안쪽\n본문")]
    assert parsers.html_tables("<table><tr></tr><tr><td>x</td></tr></table>") == [(1, "x")]


def test_formats_and_categories(spark):
    rows = spark.createDataFrame([(x,) for x in (100_000_000, 150_000_000, 10_000, 9_999, 100_005_000, 0)], "a long").select(text.krw(F.col("a")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["1억원", "1억 5000만원", "1만원", "9,999원", "1억 0만원", "0원"]
    assert _each(spark, ["C73", "D05", "D30", "D50", "I21", "I63", "E11", "J10"], nlq.code_category) == ["cancer", "cancer", "cancer", "unknown", "cardiovascular", "cardiovascular", "endocrine", "unknown"]
    assert _each(spark, ["제1장 총칙 제1조 목적 제2조 정의", "보험금", "plain text", ""], text.structure_quality) == [0.392, 0.6, 0.0, 0.0]
    assert _each(spark, ["제3조(지급) 1. 90일 동안 3.5% 이율로 50,000원, 6개월 또는 3년"], text.template_variables) == [["article:제3조(지급)", "other:1. ", "amount:50,000원", "percentage:5%", "days:90일", "months:6개월", "years:3년"]]
    assert _each(spark, ["갑상선암 보장 금액은?", "암진단비를 알려주세요", "보장되나요"], text.variations) == [["갑상선암 보장 금액은?", "갑상선암 보장 금액은"], ["암진단비를 알려주세요", "암진단비를 "], ["보장되나요"]]
    names = _each(spark, ["암", " 심근경색 ", "감기", None], lambda q: F.to_json(nlq.known_disease(q)))
    assert names == ['{"name":"암","code":"C00-C97","category":"암"}', '{"name":"심근경색","code":"I21","category":"심혈관질환"}', '{"name":"감기"}', "{}"]


def test_settings_and_ontologies(spark):
    texts = ['{"insurer_code": "a", "insurer_name": "A", "base_url": "https://a"}', '{"insurer_code": "b", "insurer_name": "B", "base_url": "https://b", "max_pages": 5, "request_delay": 0.5}', "no settings", '{"insurer_code": "c"}']
    rows = configs.settings(spark.createDataFrame([(x,) for x in texts], "q string"), "q").orderBy("insurer_code").collect()
    assert [tuple(r) for r in rows] == [("a", "https://a", "static_html", False, 100, 1.0, 3), ("b", "https://b", "static_html", False, 5, 0.5, 3)]
    nested = """{"cancer": {"subtypes": {"thyroid": {"standard": "갑상선암", "korean_names": ["갑상샘암"], "english_names": ["Thyroid Cancer"], "kcd_codes": ["C73"], "severity": "minor"}, "any": {"standard": "암", "english_names": ["Cancer"], "kcd_codes": ["C00", "C73"]}}},
    "heart": {"subtypes": {"mi": {"standard": "심근경색", "english_names": ["cancer"], "kcd_codes": ["I21"], "severity": "severe"}}}}"""
    known = ontology.entities(spark.createDataFrame([(nested,)], "q string"), "q")
    assert {tuple(r) for r in ontology.by_name(known).collect()} == {("갑상선암", "갑상선암"), ("갑상샘암", "갑상선암"), ("thyroid cancer", "갑상선암"), ("암", "암"), ("cancer", "심근경색"), ("심근경색", "심근경색")}
    assert {tuple(r) for r in ontology.by_code(known).collect()} == {("C73", "암"), ("C00", "암"), ("I21", "심근경색")}


def test_answers(spark):
    fields = [x.split(":")[0] for x in responses.RESULTS.replace("\n", "").removeprefix("array<struct<").removesuffix(">>").replace("array<string>", "array").split(",")]
    result = lambda **known: tuple(known.get(k) for k in fields)
    rows = [
        ("coverage_check", [result(disease_name="간암", is_covered=True, coverages=["암수술", ""])]), ("coverage_check", [result(disease_name="치매", is_covered=False)]), ("exclusion_check", []), ("disease_comparison", [result(item1="A", names1=["x", "y", "w"], item2="B", names2=["y"])]),
        ("product_summary", [result(coverage_name="암진단", amount=1000), result()]), ("general_info", [result(body="본문")]),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, intent string, results {responses.RESULTS}")
    got = [tuple(r["g"]) for r in frame.select("i", responses.generated(F.col("intent"), F.lit("?"), F.col("results")).alias("g")).orderBy("i").collect()]
    assert got[0] == ("간암은(는) 보장 대상입니다.\n\n다음 보장에 포함됩니다:\n- 암수술", "text", 0.95)
    assert got[1][0].startswith("치매은(는) 현재 보장 대상이 아닙니다.") and got[2] == ("제외되는 질병 정보를 찾을 수 없습니다.", "text", 0.5)
    assert got[3] == ("A과(와) B의 보장 비교:\n\n**공통점:**\n- 공통 보장: y\n\n**차이점:**\n- A만 해당: w, x", "comparison", 0.85)
    assert got[4] == ("**보험 상품**\n\n\n\n**주요 보장:**\n- 암진단: 1,000원\n- 알 수 없음", "summary", 0.85) and got[5] == ("본문", "text", 0.7)


@pytest.mark.parametrize(("row", "want"), [((1, *[True] * 7, 0, 0, 0, 0, 0, 0, 100, 50, 10, 50, 1, 1, 1, 10, 1.0), [1.0] * 5), ((2, False, *[True] * 5, False, 1, 2, 5, 10, 0, 5, 100, 50, 1, 0, 0, 0, 0, 0, 0.5), [0.7, 0.4, 0.55, 0.3, 0.5125]), ((3, *[False] * 7, 5, 5, 5, 9, 9, 9, 9, 9, 0, 0, 0, 0, 0, 0, 0.0), [0.0] * 5)])
def test_quality_of_documents(spark, row, want):
    assert list(spark.createDataFrame([row], answers.CHECKED).select(*[c.alias(k) for k, c in answers.quality().items()]).first()) == want


def test_matching_and_steps(spark):
    rows = [(40, "life", False, "Seoul", 4, 100), (55, "life", True, None, 0, 30), (30, "health", False, "", 0, 90), (45, "health", True, "x", 3, 40), (None, "life", True, None, 0, 20), (35, "auto", False, "B", 9, 80)]
    frame = spark.createDataFrame(rows, "age int, product string, same boolean, city string, n int, want int")
    assert frame.filter(compliance.matching_score(F.col("age"), F.col("product"), F.col("same"), F.col("city"), F.col("n")) != F.col("want")).count() == 0
    steps = [("discovered", "queued", True), ("completed", "queued", False), ("discovered", "failed", False), ("failed", "queued", True), ("ignored", "discovered", True), ("unknown", "queued", False)]
    frame = spark.createDataFrame(steps, "a string, b string, want boolean")
    assert frame.filter(compliance.allowed_step(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_documents_as_read(spark):
    schema = "articles array<struct<num:string,paragraphs:array<string>>>, amounts array<double>, periods array<int>, codes array<struct<code:string,is_valid:boolean>>, relations array<struct<subject:string,object:string,confidence:double>>, links array<struct<mention:string,matched:string>>"
    rows = [([("1", ["", "x"]), ("1", []), ("3", None)], [0.0, 2e10, None], [-1, 4000, 30], [("ZZ", False)], [("", "b", 0.4), ("a", None, 0.9)], [("x", None), ("y", "z")]), ([], [], [], [], [], []), (None,) * 6]
    frame = spark.createDataFrame(rows, schema)
    found = [[(i["issue"], i["n"]) for i in r["x"]] for r in frame.select(checks.data_issues(*[F.col(c) for c in frame.columns]).alias("x")).collect()]
    assert found[0] == [("repeated articles", 1), ("articles without paragraphs", 2), ("empty paragraphs", 1), ("invalid amounts", 1), ("large amounts", 1), ("invalid periods", 1), ("long periods", 1), ("invalid codes", 1), ("no subject", 1), ("no object", 1), ("low confidence", 1), ("failed links", 1)]
    assert found[1:] == [[("no articles", 1), ("no data", 1), ("no relations", 1), ("no links", 1)], []]
