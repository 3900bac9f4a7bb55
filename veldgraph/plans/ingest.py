"""Ingestion of contract texts from end to end, with the parsers' variants, and masks one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldgraph.functions import nlq, parsers, pii
from veldgraph.operators import extractions, vector
from veldgraph.plans import Plans, Tables
from veldgraph.plans.retrieval import COS, RAW

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

#: A contract text for each part: fixed wording with numbers of the row, an article within a line, nothing, or an empty text.
CONTRACT = """CASE p_partkey % 4 WHEN 0 THEN '제1조(목적) 이 약관은 ' || (p_partkey % 9 + 1) || '억원을 지급합니다.' || chr(10) || chr(10) || '둘째 문단 ' || (p_partkey % 300 + 1) || '일' || chr(10) || '제2조(정의) C' || (p_partkey % 80 + 10) || ' 코드'
WHEN 1 THEN '머리말 제1조(가) 안쪽 표시' || chr(10) || '본문 ' || p_name WHEN 2 THEN NULL ELSE '' END"""


def _contracts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.expr(CONTRACT).alias("q"))


@P.add(f"SELECT vec_id, {COS} AS score FROM embeddings ORDER BY {RAW} DESC, vec_id LIMIT 5")
def g_vector_similarity(t: Tables) -> DataFrame:
    query = list(t.embeddings.filter("vec_id = 3").select("embedding").first()[0])
    return vector.top_k(t.embeddings, query, 5).select("vec_id", "score")


@P.add("""
WITH e AS (SELECT conv_id, turn, list_transform(range(1536), lambda i: ('0x' || substr(md5(text || ':' || i), 1, 8))::BIGINT - 2147483648) AS v FROM conversations)
SELECT conv_id, turn, len(v)::INT AS dim, v[1] / 2147483648.0::DOUBLE AS first, v[1536] / 2147483648.0::DOUBLE AS last, list_sum(v)::BIGINT AS total FROM e""")
def e_mock(t: Tables) -> DataFrame:
    """Stand-in embeddings of 1,536 numbers from -1 to 1 that depend on the text alone, shown by their ends and their sum."""
    made = t.conversations.select("conv_id", "turn", vector.stand_in(F.col("text")).alias("v"))
    whole = F.aggregate(F.transform("v", lambda x: (x * 2147483648).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return made.select("conv_id", "turn", F.size("v").alias("dim"), F.get("v", F.lit(0)).alias("first"), F.element_at("v", -1).alias("last"), whole.alias("total"))


@P.add("SELECT p_partkey AS id, 'C' || (p_partkey % 80 + 10) AS code FROM part WHERE p_partkey % 4 = 0")
def x_kcd_simple(t: Tables) -> DataFrame:
    return _contracts(t).select("id", F.explode(nlq.kcd_ranges(F.coalesce("q", F.lit("")))).alias("code"))


@P.add("SELECT p_partkey AS id, unnest(CASE p_partkey % 4 WHEN 0 THEN [1, 2] WHEN 1 THEN [0] ELSE [] END)::INT AS article, unnest(CASE p_partkey % 4 WHEN 0 THEN ['목적', '정의'] WHEN 1 THEN ['본문'] ELSE [] END) AS title FROM part")
def x_legal_parse_v2(t: Tables) -> DataFrame:
    """Articles at the beginning of a line only; a text without any is one body."""
    return parsers.mapped(_contracts(t), ["id"], "q", "article int, title string, body string", parsers.legal_lines).select("id", "article", "title")


@P.add("SELECT p_partkey AS id, unnest(CASE p_partkey % 4 WHEN 0 THEN [1, 2] WHEN 1 THEN [1] ELSE [] END)::INT AS article, unnest(CASE p_partkey % 4 WHEN 0 THEN [2, 1] WHEN 1 THEN [1] ELSE [] END)::INT AS paragraphs FROM part")
def r_articles_v3(t: Tables) -> DataFrame:
    """Paragraphs end at blank lines."""
    found = parsers.mapped(_contracts(t), ["id"], "q", "article int, title string, paragraphs int", parsers.titled_articles)
    return found.select("id", "article", "paragraphs")


@P.add("""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INT AS articles, (p_partkey % 4 = 0)::INT AS amounts, (p_partkey % 4 = 0)::INT AS periods, (p_partkey % 4 = 0)::INT AS codes, p_partkey % 4 = 0 AS complete FROM part""")
def r_simple_flow(t: Tables) -> DataFrame:
    """Parse, extract and validate without a model: how much of each kind a text has."""
    docs = _contracts(t)
    count = lambda found, name: found.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias(name))
    parts = [
        count(parsers.mapped(docs, ["id"], "q", "article int, title string, paragraphs int", parsers.titled_articles), "articles"),
        count(parsers.mapped(docs, ["id"], "q", "value bigint, place int, found string", parsers.amounts), "amounts"),
        count(parsers.mapped(docs, ["id"], "q", "days int, place int, found string", parsers.periods), "periods"),
        count(docs.select("id", F.explode(nlq.kcd_ranges(F.coalesce("q", F.lit(""))))), "codes"),
    ]
    out = docs.select("id")
    for p in parts:
        out = out.join(p, "id", "left")
    filled = out.fillna(0)
    return filled.withColumn("complete", (F.col("articles") > 0) & (F.col("amounts") > 0))


#: A contract with paragraphs and subclauses by number and by letter; an amount stands in it twice.
CLAUSES = """'제' || (p_partkey % 90 + 10) || '조 [지급]' || chr(10) || '① 다음을 지급한다.' || chr(10) || '1. ' || (p_partkey % 9 + 1) || '억원' || chr(10) || '2. C' || (p_partkey % 80 + 10) || ' 진단' || chr(10)
|| '② ' || (p_partkey % 300 + 1) || '일 이내 ' || (p_partkey % 9 + 1) || '억원' || chr(10) || '③ 다음' || chr(10) || '가. ' || p_name || chr(10) || '나. 기타'"""


@P.add("""
WITH p AS (SELECT p_partkey AS k, 'd' || p_partkey AS policy, 'd' || p_partkey || '_article_' || (p_partkey % 90 + 10) AS a FROM part)
SELECT policy, NULL AS parent, policy AS node_id, 'Policy' AS label FROM p UNION ALL SELECT policy, policy, a, 'Article' FROM p UNION ALL SELECT policy, a, a || '_para_' || i, 'Paragraph' FROM p, range(1, 4) r(i)
UNION ALL SELECT policy, a || '_para_' || x.i, a || '_para_' || x.i || '_sub_' || x.s, 'Subclause' FROM (SELECT policy, a, unnest([{'i': 1, 's': '1'}, {'i': 1, 's': '2'}, {'i': 3, 's': '가'}, {'i': 3, 's': '나'}]) AS x FROM p)
UNION ALL SELECT policy, policy, policy || '_amount_' || (k % 9 + 1) * 100000000, 'Amount' FROM p UNION ALL SELECT policy, policy, policy || '_period_' || (k % 300 + 1), 'Period' FROM p UNION ALL SELECT policy, policy, policy || '_kcdcode_C' || (k % 80 + 10), 'KCDCode' FROM p""")
def g_build_facts(t: Tables) -> DataFrame:
    """The graph of contracts down to subclauses, with what they name."""
    docs = t.part.select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("policy"), F.expr(CLAUSES).alias("text"))
    return extractions.clause_graph(docs, "policy", "text")


@P.add("SELECT page_id, " + ", ".join(f"regexp_matches(lower(html), '{p}') AS sign{i}" for i, p in enumerate(pii.XSS)) + " FROM pages")
def i_xss(t: Tables) -> DataFrame:
    """Which of the six signs of a script a page holds."""
    return t.pages.select("page_id", *[F.lower("html").rlike(p).alias(f"sign{i}") for i, p in enumerate(pii.XSS)])


@P.add("SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_partkey % 2 WHEN 0 THEN '_.pdf' ELSE '약관.pdf' END AS safe FROM part")
def i_filename(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", pii.safe_filename(F.expr("CASE p_partkey % 2 WHEN 0 THEN '../' || p_name || '?.pdf' ELSE p_name || '약관.pdf' END")).alias("safe"))
