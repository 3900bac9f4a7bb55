"""Answer assembly, validation, compliance and quality: rule engines over rows. Lines and orders stand in for citations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.functions import answers, checks, compliance, nlq, responses
from veldgraph.operators import aggregates, extractions, graph, joins
from veldgraph.plans import Plans, Tables
from veldgraph.plans.graph import GRAPH, edges_of, nodes_of

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles


#: Answers with their citations (document_id, text, confidence). Each event draws one; what it cites is named after the event.
ANSWERS = [
    ("암 진단금?", "보험금은 전액 지급됩니다.", []),
    ("면책 사항은?", "면책기간은 90일입니다.", [("d1", "제5조 면책기간은 90일로 한다.", 0.9)]),
    ("비교", "가" * 400, [("d1", "short", 0.5)]),
    ("금액", "1,000원, 2,000원, 30원 그리고 4.5%", [("d2", "x" * 20, None), ("", "x" * 20, 0.8)]),
    ("?", "무조건 가입 가능, 반드시 100% 지급", []),
    ("?", "보장" * 600, [("d3", "x" * 20, 0.6), ("d4", "x" * 20, 0.95)]),
    ("?", "모든 경우 보장", [("d5", "x" * 20, 0.9)]),
]


def _drawn(t: Tables, cases: list[tuple], schema: str) -> DataFrame:
    """Each event with the case that its id draws."""
    known = t.spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"k long, {schema}")
    return t.events.select(F.col("event_id").alias("id"), "event_type", (F.col("event_id") % len(cases)).alias("k")).join(F.broadcast(known), "k").drop("k")  # a few rows


def _answers(t: Tables) -> DataFrame:
    drawn = _drawn(t, ANSWERS, f"question string, answer string, citations {compliance.CITATIONS}")
    named = lambda c: F.when(c["document_id"] != "", F.concat_ws("-", c["document_id"], "id")).otherwise("")
    cited = F.transform("citations", lambda c: F.struct(named(c).alias("document_id"), c["text"].alias("text"), c["confidence"].alias("confidence")))
    return drawn.withColumns({"citations": cited, "question": F.concat_ws(" ", "question", "event_type")})


def _sql(columns: str, *rows: tuple) -> str:
    """What is expected of each event, by the case that it draws."""
    shown = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v)
    n = max(r[0] for r in rows)
    values = ", ".join("(" + ", ".join(map(shown, (r[0] - 1, *r[1:]))) + ")" for r in rows)
    rest = columns.split(", ", 1)[1]
    return f"SELECT event_id AS id, {rest} FROM events JOIN (VALUES {values}) v(k, {rest}) ON k = event_id % {n}"


@P.add("""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name || '의 경우 다음과 같이 보장됩니다:' || chr(10) || chr(10) || '- ' || p_type || chr(10) || chr(10) || '총 ' || p_size || '억원원의 보장을 받으실 수 있습니다.'
WHEN 1 THEN '가입 가능 연령은 ' || p_size || '세부터 ' || (p_size + 40) || '세까지입니다.' WHEN 2 THEN p_brand ELSE '죄송합니다. ' || p_brand || '에 대한 정보를 찾을 수 없습니다.' || chr(10) || chr(10) || '다른 질문을 해주시거나, 더 구체적으로 질문해주세요.' END AS shown FROM part""")
def a_templates(t: Tables) -> DataFrame:
    """The template of an intent with its variables filled in; another intent has the general one."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    intent = F.when(k == 1, "age_limit").when(k == 2, "complex_query").otherwise("coverage_amount")
    values = {"disease_name": "p_name", "coverage_list": F.concat(F.lit("- "), "p_type"), "total_amount": F.concat(size.cast("string"), F.lit("억원")), "min_age": size.cast("string"), "max_age": (size + 40).cast("string"), "answer": "p_brand", "query": "p_brand"}
    variables = F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.col(v) if isinstance(v, str) else v)])
    return t.part.select(F.col("p_partkey").alias("id"), answers.rendered(answers.template(intent, k != 3), variables).alias("shown"))


_EOK = "CASE WHEN total >= 100000000 AND total % 100000000 = 0 THEN total // 100000000 || '억원' WHEN total >= 100000000 THEN total // 100000000 || '억 ' || total % 100000000 // 10000 || '만원' WHEN total >= 10000 THEN total // 10000 || '만원' ELSE format('{:,}', total) || '원' END"


@P.add(f"""
WITH l AS (SELECT l_orderkey, string_agg('- ' || p_name || ': ' || format('{{:,}}', w) || '원', chr(10) ORDER BY w, p_partkey) AS paid, string_agg('- ' || p_brand, chr(10) ORDER BY w, p_partkey) AS brands, sum(w)::BIGINT AS total, arg_min(p_brand, (w, p_partkey)) AS brand, arg_min(p_size, (w, p_partkey)) AS days
 FROM (SELECT l_orderkey, p_name, p_brand, p_size, p_partkey, round(l_extendedprice)::BIGINT AS w FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY l_orderkey)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 AND l_orderkey IS NULL THEN '제외되는 질병 정보를 찾을 수 없습니다.' WHEN l_orderkey IS NULL THEN '죄송합니다. ' || o_orderpriority || '에 대한 정보를 찾을 수 없습니다.' || chr(10) || chr(10) || '다른 질문을 해주시거나, 더 구체적으로 질문해주세요.'
 WHEN o_orderkey % 4 = 0 THEN brand || '의 경우 다음과 같이 보장됩니다:' || chr(10) || chr(10) || paid || chr(10) || chr(10) || '총 ' || {_EOK} || '원의 보장을 받으실 수 있습니다.' WHEN o_orderkey % 4 = 1 THEN '다음 질병은 보장에서 제외됩니다:' || chr(10) || chr(10) || brands
 WHEN o_orderkey % 4 = 2 THEN '해당 보장의 대기기간은 ' || days || '일입니다.' || chr(10) || chr(10) || '계약일로부터 ' || days || '일 이후에 발생한 사고에 대해 보장받으실 수 있습니다.' ELSE '정보를 찾았습니다.' END AS answer,
 CASE WHEN l_orderkey IS NULL THEN 'text' WHEN o_orderkey % 4 = 0 THEN 'table' WHEN o_orderkey % 4 = 1 THEN 'list' ELSE 'text' END AS format, CASE WHEN l_orderkey IS NULL THEN CASE o_orderkey % 4 WHEN 1 THEN 0.5 ELSE 0 END WHEN o_orderkey % 4 = 2 THEN 0.95 WHEN o_orderkey % 4 = 3 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def a_generate(t: Tables) -> DataFrame:
    """The answer to an intent, its format and confidence, from an order's lines as the rows that were found."""
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_size")
    won = F.round("l_extendedprice").cast("long")
    fields = {"amount": won, "coverage_name": F.when(F.col("l_orderkey") % 4 == 0, F.col("p_name")), "disease_name": F.col("p_brand"), "days": F.col("p_size")}
    types = dict(x.split(":") for x in responses.RESULTS.replace("\n", "").removeprefix("array<struct<").removesuffix(">>").replace("array<string>", "array").split(","))
    result = F.struct(*[fields.get(c, F.lit(None)).cast(k.replace("array", "array<string>")).alias(c) for c, k in types.items()])
    found = t.lineitem.join(parts, "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(won.alias("w"), "l_partkey", result.alias("r")))).alias("x"))
    found = found.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("x", lambda y: y["r"]).alias("results"))
    k = F.col("o_orderkey") % 4
    intent = F.when(k == 0, "coverage_amount").when(k == 1, "exclusion_check").when(k == 2, "waiting_period").otherwise("?")
    asked = t.orders.join(found, "o_orderkey", "left").withColumn("results", F.coalesce("results", F.array().cast(responses.RESULTS)))
    return asked.select(F.col("o_orderkey").alias("id"), responses.generated(intent, F.col("o_orderpriority"), F.col("results")).alias("g")).select("id", "g.*")


@P.add(f"WITH {GRAPH} SELECT d.name AS disease, count(c.amount) AS n, sum(c.amount)::BIGINT AS total FROM edges e JOIN nodes d ON e.dst = d.node_id JOIN nodes c ON e.src = c.node_id WHERE rel_type = 'COVERS' GROUP BY d.name")
def a_amount(t: Tables) -> DataFrame:
    found = graph.related(nodes_of(t), edges_of(t), "COVERS", "Disease", "Coverage", "d", "c").filter("c_amount is not null")
    return found.groupBy(F.col("d_name").alias("disease")).agg(F.count("c_amount").alias("n"), F.sum("c_amount").alias("total"))


@P.add("""
WITH s AS (SELECT p_brand, list_sort(list_distinct(list(p_type || p_size % 3))) AS x FROM part GROUP BY p_brand),
b AS (SELECT a.p_brand AS a, b.p_brand AS b, list_sort(list_intersect(a.x, b.x)) AS common, list_filter(a.x, lambda v: NOT list_contains(b.x, v)) AS only_a, list_filter(b.x, lambda v: NOT list_contains(a.x, v)) AS only_b FROM s a JOIN s b ON b.p_brand = 'Brand#1' AND a.p_brand <> 'Brand#1')
SELECT a, b, CASE WHEN len(common) = 0 THEN '없음' ELSE '- 공통 보장: ' || array_to_string(common, ', ') END AS similarities,
CASE WHEN len(only_a) = 0 AND len(only_b) = 0 THEN '없음' ELSE concat_ws(chr(10), CASE WHEN len(only_a) > 0 THEN '- ' || a || '만 해당: ' || array_to_string(only_a, ', ') END, CASE WHEN len(only_b) > 0 THEN '- ' || b || '만 해당: ' || array_to_string(only_b, ', ') END) END AS differences FROM b""")
def a_compare(t: Tables) -> DataFrame:
    """What each brand has in common with one of them, and what not."""
    s = t.part.groupBy("p_brand").agg(F.collect_set(F.concat("p_type", (F.col("p_size") % 3).cast("string"))).alias("x"))
    one = s.filter("p_brand = 'Brand#1'").select(F.col("p_brand").alias("b"), F.col("x").alias("y"), F.lit(1).alias("one"))
    both = s.filter("p_brand <> 'Brand#1'").withColumn("one", F.lit(1)).join(F.broadcast(one), "one")  # one row
    return both.select(F.col("p_brand").alias("a"), "b", responses.compared(F.col("p_brand"), F.col("x"), F.col("b"), F.col("y")).alias("c")).select("a", "b", "c.*")


@P.add("""
WITH top AS (SELECT l_orderkey, string_agg(left(l_partkey::VARCHAR, 500), ';' ORDER BY rn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 5 GROUP BY l_orderkey) SELECT * FROM top""")
def a_context(t: Tables) -> DataFrame:
    top = aggregates.last_n(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey")], 5)
    found = top.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("o"), "l_linenumber", "l_partkey"))).alias("x"))
    return found.select("l_orderkey", F.array_join(F.transform("x", lambda r: F.left(r["l_partkey"].cast("string"), F.lit(500))), ";").alias("context"))


@P.add("""
WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') > 0 AS path, sum(length(o_orderpriority))::INT AS len FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(least(0.5 + CASE WHEN n >= 5 THEN 0.3 WHEN n >= 3 THEN 0.2 WHEN n >= 1 THEN 0.1 ELSE 0 END + CASE WHEN path THEN 0.1 ELSE 0 END + CASE WHEN len > 200 THEN 0.1 ELSE 0 END, 1), 6)::DOUBLE AS confidence FROM g""")
def a_confidence(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("o_orderstatus") == "O") > 0).alias("path"), F.sum(F.length("o_orderpriority")).alias("len"))
    return g.select("o_custkey", nlq.answer_confidence(F.col("n"), F.col("path"), F.col("len")).alias("confidence"))


@P.add(_sql("id, level, confidence, issues", (1, "WARNING", 0.729, "facts WARNING,completeness WARNING"), (2, "PASS", 0.8, ""), (3, "FAIL", 0.091125, "source FAIL,facts WARNING,facts WARNING,invention FAIL,invention FAIL,invention WARNING"), (4, "FAIL", 0.45, "source FAIL,completeness WARNING")))
def a_validate(t: Tables) -> DataFrame:
    """Answers against their sources: a short one that leaves out an exception, a sound one, an invented one, one that cites what was not found."""
    rows = [
        ("암 보험금은 얼마?", "암 보험금은 3000만원 지급됩니다.", ["n1"], [("n1", "암 진단 시 3000만원 지급")], 0.9), ("보험금은?", "보험금은 3000만원이며 " + "가" * 40, ["n1"], [("n1", "3000만원 지급")], 0.8),
        ("", "대략 C73 치료 시 500만원", [], [("n1", "본문")], 1.0), ("나다", "가" * 60, ["n9"], [("n1", "본문"), ("n2", None)], 1.0),
    ]
    asked = _drawn(t, rows, "question string, answer string, cited array<string>, results array<struct<node_id:string,text:string>>, confidence double")
    found = asked.withColumn("i", checks.answer_issues(F.col("question"), F.col("answer"), F.col("cited"), F.col("results")))
    shown = F.array_join(F.transform("i", lambda x: F.concat_ws(" ", x["stage"], x["level"])), ",")
    return found.select("id", checks.answer_verdict(F.col("i"), F.col("confidence")).alias("v"), shown.alias("issues")).select("id", "v.*", "issues")


@P.add(_sql("id, issues", (1, "exclusions"), (2, "query"), (3, ""), (4, "query"), (5, "")))
def a_complete(t: Tables) -> DataFrame:
    rows = [(["암"], "암은 보장됩니다", ["다만 90일 이내 제외"]), (["암"], "지급합니다", ["plain"]), ([], "ok", []), (["암"], "다만 안 됩니다", ["제외"]), (["a"], "A", ["s1", "s2", "s3", "s4", "s5", "제외"])]
    asked = _drawn(t, rows, "words array<string>, answer string, sources array<string>")
    return asked.select("id", F.array_join(compliance.completeness_issues(F.col("words"), F.col("answer"), F.col("sources")), ",").alias("issues"))


@P.add(_sql("id, place, error", (2, 0, None), (3, 0, "Citation text too short (< 10 characters)"), (4, 0, None), (4, 1, "Missing required field: document_id"), (6, 0, None), (6, 1, None), (7, 0, None)))
def k_citation(t: Tables) -> DataFrame:
    return _answers(t).select("id", F.posexplode("citations").alias("place", "c")).select("id", "place", compliance.citation_error(F.col("c")).alias("error"))


@P.add(_sql("id, enough", (1, False), (2, True), (3, True), (4, True), (5, False), (6, False), (7, True)))
def k_coverage(t: Tables) -> DataFrame:
    return _answers(t).select("id", compliance.enough_citations(F.col("answer"), F.col("citations")).alias("enough"))


@P.add(_sql("id, points, risk", (1, 50, "high"), (2, 0, "low"), (3, 35, "medium"), (4, 0, "low"), (5, 50, "high"), (6, 15, "low"), (7, 0, "low")))
def k_risk(t: Tables) -> DataFrame:
    points = compliance.risk_points(F.col("answer"), F.col("citations"))
    return _answers(t).select("id", points.alias("points"), compliance.risk_level(points).alias("risk"))


@P.add(_sql("id, citations, valid, confidence, points, risk", (1, 0, 0, 0.0, 50, "high"), (2, 1, 1, 0.9, 0, "low"), (3, 1, 0, 0.5, 35, "medium"), (4, 2, 1, 0.8, 0, "low"), (5, 0, 0, 0.0, 50, "high"), (6, 2, 2, 0.775, 15, "low"), (7, 1, 1, 0.9, 0, "low")))
def k_trace(t: Tables) -> DataFrame:
    return _answers(t).select("id", compliance.trace(F.col("answer"), F.col("citations")).alias("r")).select("id", "r.*")


@P.add(_sql("id, category, explained, caution, prohibited", (1, "coverage", True, "전액", ""), (2, "exclusion", True, "", ""), (3, "other", True, "", ""), (4, "other", True, "", ""), (5, "coverage", True, "100%,무조건,반드시", "무조건 가입"), (6, "coverage", True, "", ""), (7, "coverage", True, "모든", "")))
def k_duty(t: Tables) -> DataFrame:
    """What has to be explained, whether it is, and words that ask for care or are not to be used."""
    kind = compliance.category(F.col("question"), F.col("answer"))
    words = lambda w: F.array_join(compliance.words_in(F.col("answer"), w), ",")
    return _answers(t).select("id", kind.alias("category"), compliance.explained(F.col("answer"), kind).alias("explained"), words(compliance.CAUTION_WORDS).alias("caution"), words(compliance.PROHIBITED_WORDS).alias("prohibited"))


@P.add(_sql("id, level", (1, "fail"), (2, "pass"), (3, "fail"), (4, "fail"), (5, "fail"), (6, "fail"), (7, "warning")))
def k_level(t: Tables) -> DataFrame:
    a, c = F.col("answer"), F.col("citations")
    issues = F.when(compliance.enough_citations(a, c), 0).otherwise(1) + F.size(compliance.words_in(a, compliance.PROHIBITED_WORDS))
    valid = F.forall(c, lambda x: compliance.citation_error(x).isNull())
    found = compliance.level(issues, F.size(compliance.words_in(a, compliance.CAUTION_WORDS)), compliance.risk_level(compliance.risk_points(a, c)), valid, compliance.explained(a, compliance.category(F.col("question"), a)))
    return _answers(t).select("id", found.alias("level"))


_PARTS = ["articles", "amounts", "periods", "codes", "relations", "links"]


def _read(t: Tables) -> DataFrame:
    """Each order as a document that was read, its lines as what was found in it; every eleventh order has no result at all."""
    c = F.col
    fields = {
        "articles": F.struct(c("l_linenumber").cast("string").alias("num"), F.when(c("l_returnflag") == "R", F.array().cast("array<string>")).otherwise(F.array(F.when(c("l_returnflag") == "N", "").otherwise("x"), c("l_linestatus"))).alias("paragraphs")),
        "amounts": (c("l_extendedprice") - 20_000) * F.when(c("l_tax") > 0.07, 1_000_000).otherwise(1), "periods": (c("l_quantity").cast("int") - 5) * F.when(c("l_tax") < 0.01, 100).otherwise(1),
        "codes": F.struct(c("l_partkey").cast("string").alias("code"), (c("l_tax") > 0.02).alias("is_valid")), "links": F.struct(F.lit("m").alias("mention"), F.when(c("l_tax") != 0, "x").alias("matched")),
        "relations": F.struct(F.when(c("l_returnflag") == "A", " ").otherwise("s").alias("subject"), F.when(c("l_linestatus") == "F", "o").alias("object"), (c("l_discount") * 10).alias("confidence")),
    }
    lines = t.lineitem.groupBy(c("l_orderkey").alias("id")).agg(*[F.collect_list(v).alias(k) for k, v in fields.items()])
    docs = t.orders.select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 11 > 0, F.round(c("o_totalprice") / 500_000, 6)).alias("quality")).join(lines, "id", "left")
    known = {k: F.when(c("id") % 11 > 0, F.coalesce(c(k), F.array().cast(docs.schema[k].dataType))) for k in _PARTS}
    return docs.withColumns(known).withColumn("issues", checks.data_issues(*[c(k) for k in _PARTS]))


_ISSUES = """
WITH a AS (SELECT *, (l_extendedprice - 20000) * CASE WHEN l_tax > 0.07 THEN 1000000 ELSE 1 END AS amount, (l_quantity::INT - 5) * CASE WHEN l_tax < 0.01 THEN 100 ELSE 1 END AS days FROM lineitem),
n AS (SELECT o_orderkey AS id, round(o_totalprice / 500000, 6)::DOUBLE AS quality, count(l_orderkey) AS lines, count(l_orderkey) - count(DISTINCT l_linenumber) AS repeated, count(*) FILTER (l_returnflag = 'R') AS bare, count(*) FILTER (l_returnflag = 'N') AS blank, count(*) FILTER (amount <= 0) AS invalid, count(*) FILTER (amount > 10000000000) AS large,
 count(*) FILTER (days <= 0) AS negative, count(*) FILTER (days > 3650) AS long, count(*) FILTER (l_tax <= 0.02) AS codes, count(*) FILTER (l_returnflag = 'A') AS subject, count(*) FILTER (l_linestatus <> 'F') AS object, count(*) FILTER (l_discount * 10 < 0.5) AS low, count(*) FILTER (l_tax = 0) AS failed
 FROM orders LEFT JOIN a ON l_orderkey = o_orderkey WHERE o_orderkey % 11 > 0 GROUP BY ALL),
i AS (SELECT id, quality, unnest([{'i': 'no articles', 's': 'critical', 'n': (lines = 0)::BIGINT}, {'i': 'repeated articles', 's': 'warning', 'n': repeated}, {'i': 'articles without paragraphs', 's': 'warning', 'n': bare}, {'i': 'empty paragraphs', 's': 'info', 'n': blank}, {'i': 'no data', 's': 'warning', 'n': (lines = 0)::BIGINT},
 {'i': 'invalid amounts', 's': 'error', 'n': invalid}, {'i': 'large amounts', 's': 'warning', 'n': large}, {'i': 'invalid periods', 's': 'error', 'n': negative}, {'i': 'long periods', 's': 'warning', 'n': long}, {'i': 'invalid codes', 's': 'warning', 'n': codes}, {'i': 'no relations', 's': 'warning', 'n': (lines = 0)::BIGINT},
 {'i': 'no subject', 's': 'error', 'n': subject}, {'i': 'no object', 's': 'error', 'n': object}, {'i': 'low confidence', 's': 'info', 'n': low}, {'i': 'no links', 's': 'warning', 'n': (lines = 0)::BIGINT}, {'i': 'failed links', 's': 'info', 'n': failed}]) AS x FROM n)"""


@P.add(f"""
{_ISSUES} SELECT o.o_orderkey AS id, x.i AS issue, x.s AS severity, x.n AS n, round(coalesce(CASE WHEN lines > 0 AND o.o_orderkey % 11 > 0 THEN 1 - failed / lines END, 0), 6)::DOUBLE AS link_rate
FROM orders o LEFT JOIN n ON n.id = o.o_orderkey LEFT JOIN (SELECT * FROM i WHERE x.n > 0) i ON i.id = o.o_orderkey""")
def d_data_valid(t: Tables) -> DataFrame:
    shown = _read(t).select("id", F.explode_outer("issues").alias("i"), F.round(F.coalesce(checks.link_rate(F.col("links")), F.lit(0.0)), 6).alias("link_rate"))
    return shown.select("id", "i.issue", "i.severity", "i.n", "link_rate")


@P.add(f"""
WITH {GRAPH}, i AS (SELECT 'no nodes' AS issue, 'critical' AS severity, ((SELECT count(*) FROM nodes) = 0)::BIGINT AS n UNION ALL SELECT 'no edges', 'warning', ((SELECT count(*) FROM edges) = 0)::BIGINT
UNION ALL SELECT 'no ' || l, s, ((SELECT count(*) FROM nodes WHERE label = l) = 0)::BIGINT FROM (VALUES ('Product', 'error'), ('Clause', 'error'), ('Coverage', 'warning'), ('Disease', 'warning')) v(l, s)
UNION ALL SELECT 'several Product', 'warning', CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END FROM nodes WHERE label = 'Product'
UNION ALL SELECT 'no ' || r, 'warning', ((SELECT count(*) FROM edges WHERE rel_type = r) = 0)::BIGINT FROM (VALUES ('COVERS'), ('HAS_COVERAGE')) v(r)
UNION ALL SELECT 'orphans', 'warning', count(*) FROM nodes WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = node_id OR dst = node_id)
UNION ALL SELECT 'invalid COVERS', 'error', count(*) FROM edges e LEFT JOIN nodes a ON e.src = a.node_id LEFT JOIN nodes b ON e.dst = b.node_id WHERE rel_type = 'COVERS' AND NOT coalesce(a.label = 'Coverage' AND b.label = 'Disease', false))
SELECT issue, severity, n FROM i WHERE n > 0""")
def d_graph_valid(t: Tables) -> DataFrame:
    return graph.issues(nodes_of(t), edges_of(t))


_QUALITY = """
WITH x AS (SELECT p_partkey AS id, p_partkey AS k, p_size AS n FROM part), q AS (SELECT id,
 greatest(0, least(1, 1 - 0.3 * (k % 2)::INT - 0.2 * (k // 2 % 2)::INT - 0.2 * (k // 4 % 2)::INT - 0.1 * (k // 8 % 2)::INT - 0.1 * (k // 16 % 2)::INT - 0.1 * (k // 32 % 2)::INT)) AS completeness, greatest(0, least(1, 1 - 0.3 * (k % 3) - 0.1 * (k % 5) - 0.02 * (k % 7))) AS accuracy,
 greatest(0, least(1, 1 - 0.4 * (k // 64 % 2)::INT - (k % 4) / greatest(n, 1) * 0.3 - (k % 5) / greatest(n, 1) * 0.2 - (k % 6) / greatest(n, 1) * 0.2)) AS consistency,
 greatest(0, least(1, CASE WHEN k % 20 > 0 THEN 0.2 ELSE 0 END + CASE WHEN k % 20 >= 10 THEN 0.1 ELSE 0 END + CASE WHEN n > 0 THEN 0.1 ELSE 0 END + CASE WHEN n >= 50 THEN 0.1 ELSE 0 END + CASE WHEN k % 3 > 0 THEN 0.1 ELSE 0 END + CASE WHEN k % 4 > 0 THEN 0.05 ELSE 0 END + CASE WHEN k % 5 > 0 THEN 0.05 ELSE 0 END
  + CASE WHEN k % 15 > 0 THEN 0.1 ELSE 0 END + CASE WHEN k % 15 >= 10 THEN 0.1 ELSE 0 END + (k % 11) / 10 * 0.2)) AS coverage FROM x)
SELECT id, round(completeness, 6)::DOUBLE AS completeness, round(accuracy, 6)::DOUBLE AS accuracy, round(consistency, 6)::DOUBLE AS consistency, round(coverage, 6)::DOUBLE AS coverage,
 floor((round(completeness, 6) * 0.3 + round(accuracy, 6) * 0.3 + round(consistency, 6) * 0.25 + round(coverage, 6) * 0.15) * 1000 + 0.01)::BIGINT AS overall_milli FROM q"""


@P.add(_QUALITY)
def d_quality(t: Tables) -> DataFrame:
    """The quality of what was read from a document, from the outcome of its checks; a part's key and size give outcomes and counts."""
    k, n = F.col("p_partkey"), F.col("p_size")
    flags = ["structure_valid", "critical_valid", "relations_valid", "entities_valid", "nodes_valid", "edges_valid", "consistent"]
    bits = {name: F.shiftright(k, i) % 2 == 0 for i, name in enumerate(flags)}
    counts = {"criticals": k % 3, "errors": k % 5, "warnings": k % 7, "orphans": k % 4, "duplicates": k % 5, "invalid": k % 6, "nodes": n, "edges": n, "articles": k % 20, "paragraphs": n, "amounts": k % 3, "periods": k % 4, "codes": k % 5, "relations": k % 15, "link_rate": k % 11 / 10}
    checked = t.part.select(k.alias("id"), *[v.alias(c) for c, v in (bits | counts).items()])
    found = checked.select("id", *[v.alias(c) for c, v in answers.quality().items()])
    return found.withColumn("overall_milli", F.floor(F.col("overall") * 1000 + 0.01)).drop("overall")


@P.add("""
WITH d AS (SELECT source, count(*) AS articles, count(DISTINCT doc_id) AS ids, sum(length(text)) AS chars, sum(len(string_split(text, chr(10)))) AS parts, count(*) FILTER (coalesce(text, '') = '') AS empty, count(*) FILTER (length(text) > 10000) AS long FROM documents GROUP BY source),
l AS (SELECT source, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source), e AS (SELECT source, count(*) AS n, max(len(embedding)) AS dim FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY source),
s AS (SELECT d.*, l.n AS entities, e.n AS embedded, e.dim, (chars IS NOT NULL AND l.n IS NOT NULL AND e.n IS NOT NULL)::INT AS every, (ids <> articles)::INT AS repeated FROM d LEFT JOIN l USING (source) LEFT JOIN e USING (source)),
c AS (SELECT source, 10 + 4 * every AS checks, (coalesce(chars, 0) < 100)::INT + (entities IS NULL)::INT + (embedded IS NULL)::INT + every * (2 * repeated + coalesce(embedded <> articles + parts, false)::INT + coalesce(dim <> 64, false)::INT) + (empty > 0)::INT + (long > 0)::INT + repeated AS failed,
  coalesce(chars, 0) >= 100 AND repeated = 0 AND every * coalesce(dim <> 64, false)::INT = 0 AS ok FROM s)
SELECT source, checks::INT AS checks, (checks - failed)::INT AS passed, ok FROM c""")
def d_pipeline(t: Tables) -> DataFrame:
    """The fourteen checks of each source's stages: documents are articles, their lines paragraphs, labels what was extracted."""
    docs = t.documents.groupBy("source").agg(
        F.sum(F.length("text")).alias("total_chars"), F.count(F.lit(1)).alias("articles"), F.sum(F.size(F.split("text", "\n"))).alias("paragraphs"), F.countDistinct("doc_id").alias("article_nodes"),
        F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty_articles"), F.count_if(F.length("text") > 10_000).alias("long_articles"),
    )
    owner = t.documents.select("doc_id", "source")
    labelled = t.labels.join(owner, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("entities"))
    embedded = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dim")).join(owner, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("embeddings"), F.max("dim").alias("dim"))
    s = docs.join(labelled, "source", "left").join(embedded, "source", "left")
    lines = F.coalesce("paragraphs", F.lit(0))
    s = s.withColumns({"subclauses": F.lit(0), "duplicate_articles": F.col("articles") - F.col("article_nodes"), "policy_nodes": F.lit(1), "structural_nodes": F.col("article_nodes") + lines, "nodes": 1 + F.col("article_nodes") + lines + F.coalesce("entities", F.lit(0))})
    return s.select("source", checks.pipeline_report(64).alias("r")).select("source", "r.checks", "r.passed", "r.ok")


@P.add("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN 20 + c_custkey % 50 END AS age, CASE c_custkey % 3 WHEN 0 THEN 'life' WHEN 1 THEN 'health' ELSE 'auto' END AS product, c_mktsegment = 'BUILDING' AS same, CASE WHEN c_custkey % 4 > 0 THEN n_name ELSE '' END AS city, count(o_orderkey) AS n
 FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, greatest(0, least(100, 50 + CASE WHEN product = 'life' AND age BETWEEN 30 AND 50 THEN 20 WHEN product = 'life' AND age > 50 THEN 10 WHEN product = 'health' AND age < 40 THEN 25 WHEN product = 'health' AND age >= 40 THEN 15 ELSE 0 END
 + CASE WHEN same THEN -30 ELSE 15 END + CASE WHEN coalesce(city, '') <> '' THEN 5 ELSE 0 END + CASE WHEN n > 3 THEN 10 ELSE 0 END))::INT AS score FROM c""")
def m_matching(t: Tables) -> DataFrame:
    """Customers and a product each; orders stand for consultations, nations for cities."""
    asked = joins.with_child_count(t.customer, t.orders, "c_custkey", "o_custkey", "n").join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    k = F.col("c_custkey")
    age, product, city = F.when(k % 9 > 0, 20 + k % 50), F.when(k % 3 == 0, "life").when(k % 3 == 1, "health").otherwise("auto"), F.when(k % 4 > 0, F.col("n_name")).otherwise("")
    return asked.select("c_custkey", compliance.matching_score(age, product, F.col("c_mktsegment") == "BUILDING", city, F.col("n")).cast("int").alias("score"))


#: Statuses that types of events stand for.
_STATUS = {"view": "discovered", "click": "queued", "signup": "downloading", "purchase": "processing", "error": "failed"}


@P.add(f"""
WITH s AS (SELECT event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} ELSE 'completed' END AS status, user_id, ts FROM events),
b AS (SELECT event_id, status, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
SELECT event_id, before || '>' || status AS step, (before, status) IN (('discovered', 'queued'), ('discovered', 'ignored'), ('queued', 'downloading'), ('queued', 'failed'), ('queued', 'ignored'), ('downloading', 'processing'), ('downloading', 'failed'), ('processing', 'completed'), ('processing', 'failed'), ('failed', 'queued'),
 ('failed', 'ignored'), ('ignored', 'discovered')) AS allowed FROM b WHERE before IS NOT NULL""")
def m_transition(t: Tables) -> DataFrame:
    """Steps between the statuses of a document, against the allowed ones; users stand for documents, their events for statuses."""
    status = F.coalesce(F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("event_type")], F.lit("completed"))
    rows = t.events.withColumn("status", status)
    before = F.lag("status").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = rows.withColumn("before", before).filter("before is not null")
    return steps.select("event_id", F.concat_ws(">", "before", "status").alias("step"), compliance.allowed_step(F.col("before"), F.col("status")).alias("allowed"))


@P.add(f"""
{_ISSUES}, c AS (SELECT id, any_value(quality) AS quality, count(*) FILTER (x.n > 0) AS total, count(*) FILTER (x.n > 0 AND x.s = 'critical') AS critical, count(*) FILTER (x.n > 0 AND x.s = 'error') AS errors, count(*) FILTER (x.n > 0 AND x.s = 'warning') AS warnings FROM i GROUP BY id)
SELECT o_orderkey AS id, coalesce(total, 0)::INT AS total, coalesce(critical, 0)::INT AS critical, coalesce(errors, 0)::INT AS errors, coalesce(warnings, 0)::INT AS warnings, coalesce(critical + errors, 0) = 0 AS valid, quality >= 0.7 AS acceptable FROM orders LEFT JOIN c ON id = o_orderkey""")
def r_validate_all(t: Tables) -> DataFrame:
    return _read(t).select("id", checks.report(F.col("issues"), F.col("quality")).alias("r")).select("id", "r.*")


@P.add("""
SELECT 'entity' AS kind, p_name AS label, min(p_partkey)::VARCHAR AS src, NULL AS dst, count(*) AS n FROM part GROUP BY p_name
UNION ALL SELECT 'relation', l_returnflag, l_partkey::VARCHAR, l_suppkey::VARCHAR, 1 FROM lineitem GROUP BY l_returnflag, l_partkey, l_suppkey""")
def r_chunk_merge(t: Tables) -> DataFrame:
    """The first entity of a label stands for all; a relation counts once."""
    entities = extractions.merged_entities(t.part, "p_name", "p_partkey", ["p_partkey"])
    relations = extractions.merged_relations(t.lineitem, "l_partkey", "l_suppkey", "l_returnflag")
    shown = entities.select(F.lit("entity").alias("kind"), "label", F.col("id").cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("mentions").alias("n"))
    return shown.unionByName(relations.select(F.lit("relation").alias("kind"), F.col("type").alias("label"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(1).cast("long").alias("n")))


@P.add(f"WITH {GRAPH} SELECT 'entity' AS kind, label AS type, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'relation', rel_type, count(*) FROM edges GROUP BY rel_type UNION ALL SELECT 'tokens', 'all', sum(length(text))::BIGINT FROM conversations")
def r_chunk_agg(t: Tables) -> DataFrame:
    """How many entities and relations of each type all chunks gave, and the tokens they took."""
    tokens = t.conversations.agg(F.sum(F.length("text")).alias("n")).select(F.lit("tokens").alias("kind"), F.lit("all").alias("type"), "n")
    return extractions.histogram(nodes_of(t), F.col("label"), edges_of(t), F.col("rel_type")).unionByName(tokens)


@P.add("SELECT l_orderkey, l_linenumber, p.p_name AS src, s.s_name AS dst FROM lineitem JOIN part p ON p_partkey = l_partkey JOIN supplier s ON s_suppkey = l_suppkey WHERE l_quantity = 50 AND p_size < 25 AND s_acctbal > 5000")
def r_llm_parse(t: Tables) -> DataFrame:
    """Relations whose ends are both known."""
    lines = t.lineitem.filter("l_quantity = 50").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    known = lines.join(t.part.filter("p_size < 25"), "p_partkey").join(t.supplier.filter("s_acctbal > 5000"), "s_suppkey")
    return known.select("l_orderkey", "l_linenumber", F.col("p_name").alias("src"), F.col("s_name").alias("dst"))


@P.add(_sql("id, name, code, category", (1, "암", "C00-C97", "암"), (2, "심근경색", "I21", "심혈관질환"), (3, "감기", None, None), (4, None, None, None)))
def r_disease_kb(t: Tables) -> DataFrame:
    asked = _drawn(t, [("암",), (" 심근경색 ",), ("감기",), (None,)], "q string")
    return asked.select("id", nlq.known_disease(F.col("q")).alias("k")).select("id", "k.*")


@P.add("SELECT l.doc_id, l.quality, l.toxic, length(d.text)::BIGINT AS n FROM labels l JOIN documents d USING (doc_id) WHERE length(d.text) >= 100")
def r_reprocess(t: Tables) -> DataFrame:
    long_enough = t.documents.filter(F.length("text") >= 100).select("doc_id", F.length("text").cast("long").alias("n"))
    return t.labels.join(long_enough, "doc_id").select("doc_id", "quality", "toxic", "n")
