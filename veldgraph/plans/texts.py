"""Text queries: questions, extraction, chunks, similarity, templates and personal data. Korean inputs are made from rows of the tables, which hold none: fixed wording with the rows' numbers and names, from which the SQL tells what is expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.functions import nlq, parsers, pii, text
from veldgraph.operators import fuzzy, ratios
from veldgraph.plans import Plans, Tables
from veldgraph.sources import ontology

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

#: A row's question and contract: fixed wording, by the remainder of its key, with numbers of the row. The expressions are SQL of both engines.
_CUSTOMER = "' (고객 ' || o_custkey || ')'"
QUESTION = f"""CASE o_orderkey % 10 WHEN 0 THEN '갑상선암 보장 금액은 얼마인가요?' || {_CUSTOMER} WHEN 1 THEN '간암은 보장되나요?' || {_CUSTOMER} WHEN 2 THEN '갑상선암과 간암의 보장 차이는?' || {_CUSTOMER}
WHEN 3 THEN '대기기간은 언제부터 ' || (o_orderkey % 90 + 1) || '일 인가요' || {_CUSTOMER} WHEN 4 THEN 'C' || (o_orderkey % 80 + 10) || ' 코드와 I21.9 진단 시 ' || (o_orderkey % 9 + 1) || '억원 이상 보장' || {_CUSTOMER}
WHEN 5 THEN '면책 제외 사항' || {_CUSTOMER} WHEN 6 THEN 'hello world C' || (o_orderkey % 80 + 10) || {_CUSTOMER} WHEN 7 THEN '약관 상품 요약' || {_CUSTOMER}
WHEN 8 THEN (o_orderkey % 9 + 1) || '년 6개월 2주 수술 입원 암진단특약 ' || (o_orderkey % 9 + 1) || '천만원 이하' || {_CUSTOMER} ELSE '' END"""
CONTRACT = """CASE p_partkey % 5 WHEN 0 THEN '제' || (p_partkey % 90 + 10) || '조 [암진단급여금 지급]' || chr(10) || '① 회사는 ' || (p_partkey % 9 + 1) || '억 5천만원을 지급합니다. ② 다만, 계약일로부터 ' || (p_partkey % 300 + 1) || '일 이내에는 제외합니다.' || chr(10) || '③ 500원'
WHEN 1 THEN (p_partkey % 9 + 1) || '억원, 소액암은 ' || (p_partkey % 9 + 1) || '천만원, 고액암은 2억원입니다. ' || (p_partkey % 9 + 1) || '년 6개월 2주 1일'
WHEN 2 THEN (p_partkey % 9 + 1) || '억 5만원 그리고 ' || (p_partkey % 9 + 1) || ',000만원 및 ' || (p_partkey % 9 + 1) || '억 5백만원' WHEN 3 THEN '본문만 있습니다.' ELSE NULL END"""
QV = f"(SELECT o_orderkey AS id, {QUESTION} AS q FROM orders) x"
CV = f"(SELECT p_partkey AS id, {CONTRACT} AS q FROM part) x"
#: Numbers that a question or a contract holds.
_N, _C, _D = "(o_orderkey % 9 + 1)", "(o_orderkey % 80 + 10)", "(o_orderkey % 90 + 1)"
_PN, _PA, _PD = "(p_partkey % 9 + 1)", "(p_partkey % 90 + 10)", "(p_partkey % 300 + 1)"


def _questions(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.expr(QUESTION).alias("q"))


def _legal(t: Tables) -> DataFrame:
    return _parts(t, CONTRACT)


def _parts(t: Tables, text_: str, *columns: str) -> DataFrame:
    """(id, q): a text for each part."""
    return t.part.select(F.col("p_partkey").alias("id"), F.expr(text_).alias("q"), *columns)


def _drawn(columns: str, values: list[tuple], key: str = "o_orderkey", table: str = "orders") -> str:
    """Each row's key with what is expected of its wording, by the remainder of the key."""
    shown = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    rows = ", ".join("(" + ", ".join(map(shown, v)) + ")" for v in values)
    n = max(v[0] for v in values) + 1
    return f"SELECT {key} AS id, {columns} FROM {table} JOIN (VALUES {rows}) v(k, {columns}) ON k = {key} % {n}"


def _case(key: str, *values: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# Questions


def _score_sql(name: str, priority: int, patterns: list[str], words: list[str]) -> str:
    hit = " + ".join(f"contains(lower(q), '{p}')::INT" for p in patterns)
    said = " + ".join(f"contains(lower(q), '{w}')::INT" for w in words)
    return f"round(0.5::DOUBLE * (({hit}) / {len(patterns)}) + 0.3::DOUBLE * (({said}) / {len(words)}) + {0.2 * min(priority / 5, 1.0)!r}::DOUBLE, 6)"


SCORES = " UNION ALL ".join(f"SELECT id, '{n}' AS intent, {p} AS priority, {i} AS place, {_score_sql(n, p, pats, words)} AS score FROM {QV}" for i, (n, p, pats, words) in enumerate(nlq.INTENTS))
RANKED = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, priority DESC, place) AS rank FROM ({SCORES})"


#: Questions of each kind with the intent and the score that the weights give by hand.
ASKED = [
    ("갑상선암 보장 금액은?", "coverage_check", 0.32), ("간암 진단 시 얼마를 받나요?", "coverage_amount", 0.32), ("암 보험금은 얼마인가요?", "coverage_amount", 0.52), ("갑상선암은 보장되나요?", "coverage_check", 0.395),
    ("이 보험에 간암이 포함되나요?", "coverage_check", 0.395), ("뇌출혈도 보장 대상인가요?", "coverage_check", 0.32), ("이 보험에서 제외되는 질병은?", "exclusion_check", 0.445), ("보장 안 되는 암은 무엇인가요?", "coverage_inquiry", 0.53),
    ("면책 사항이 뭐예요?", "exclusion_check", 0.345), ("대기기간은 얼마나 되나요?", "waiting_period", 0.63), ("암 진단까지 얼마나 기다려야 하나요?", "waiting_period", 0.33), ("보험금을 받으려면 언제부터 가능한가요?", "coverage_amount", 0.32),
    ("이 보험 상품을 요약해주세요", "product_summary", 0.315), ("보험 내용을 간단히 설명해주세요", "product_summary", 0.315), ("이 보험 상품 개요는?", "unknown", 0.165),
]


@P.add("SELECT event_id AS id, intent, score FROM events JOIN (VALUES " + ", ".join(f"({i}, '{x[1]}', {x[2]}::DOUBLE)" for i, x in enumerate(ASKED)) + f") v(k, intent, score) ON k = event_id % {len(ASKED)}")
def x_intent_score(t: Tables) -> DataFrame:
    said = _case("event_id", *[f"'{x[0]}'" for x in ASKED])
    q = F.col("q")
    asked = t.events.select(F.col("event_id").alias("id"), F.expr(f"{said} || ' (' || user_id || ')'").alias("q"))
    return asked.select("id", nlq.best_intent(q).alias("intent"), F.get(nlq.intent_scores(q), F.lit(0))["score"].alias("score"))


@P.add(f"SELECT id, intent, score FROM ({SCORES})")
def x_intent_patterns(t: Tables) -> DataFrame:
    scored = _questions(t).select("id", F.explode(nlq.intent_scores(F.col("q"))).alias("s"))
    return scored.select("id", "s.intent", "s.score")


@P.add(f"SELECT a.id, a.score - b.score < 0.2 AS is_complex FROM ({RANKED}) a JOIN ({RANKED}) b ON a.id = b.id AND a.rank = 1 AND b.rank = 2")
def x_intent_complex(t: Tables) -> DataFrame:
    return _questions(t).select("id", nlq.is_complex(F.col("q")).alias("is_complex"))


@P.add(f"SELECT id, string_agg(intent, ',' ORDER BY rank) AS top FROM ({RANKED}) WHERE rank <= 3 GROUP BY id")
def x_intent_topk(t: Tables) -> DataFrame:
    return _questions(t).select("id", F.array_join(F.transform(F.slice(nlq.intent_scores(F.col("q")), 1, 3), lambda s: s["intent"]), ",").alias("top"))


@P.add(_drawn("intent", list(enumerate(['coverage_check', 'coverage_check', 'comparison', 'period_check', 'coverage_check', 'exclusion_check', 'search', 'search', 'amount_filter', 'search']))))
def x_intent_kw(t: Tables) -> DataFrame:
    return _questions(t).select("id", nlq.simple_intent(F.col("q")).alias("intent"))


def _analysed(t: Tables) -> DataFrame:
    return _questions(t).withColumns({"intent": nlq.best_intent(F.col("q")), "d": nlq.diseases(F.col("q")), "c": nlq.coverages(F.col("q"))})


@P.add(_drawn("query_type", list(enumerate(['graph_traversal', 'hybrid', 'graph_traversal', 'direct_lookup', 'hybrid', 'direct_lookup', 'hybrid', 'vector_search', 'hybrid', 'hybrid']))))
def x_query_type(t: Tables) -> DataFrame:
    return _analysed(t).select("id", nlq.query_type(F.col("intent"), F.size("d"), F.size("c")).alias("query_type"))


@P.add("SELECT o_orderkey AS id, o_orderkey % 10 IN (0, 2, 3, 7) AS answerable FROM orders")
def x_answerable(t: Tables) -> DataFrame:
    return _analysed(t).select("id", nlq.answerable(F.col("intent"), F.size("d"), F.size("c")).alias("answerable"))


@P.add("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 IN (1, 4, 5) THEN '어떤 질병에 대해 확인하고 싶으신가요?' WHEN o_orderkey % 10 IN (6, 8, 9) THEN '질문을 좀 더 구체적으로 말씀해 주시겠어요?' END AS ask FROM orders")
def x_clarify(t: Tables) -> DataFrame:
    return _analysed(t).select("id", nlq.clarification(F.col("intent"), F.col("d"), F.col("c")).alias("ask"))


_KEYWORDS = _case(
    "o_orderkey", "'갑상선암|보장|금액은|얼마인가요?'", "'간암은|보장되나요?'", "'갑상선암|갑상선암과|간암의|보장|차이는?'", f"'대기기간은|언제부터|' || {_D} || '일|인가요'", f"'C' || {_C} || '|코드와|I21.9|진단|' || {_N} || '억원|이상|보장'",
    "'면책|제외|사항'", f"'hello|world|C' || {_C}", "'약관|상품|요약'", f"{_N} || '년|6개월|2주|수술|입원|암진단특약|' || {_N} || '천만원|이하'", "''",
)


@P.add(f"SELECT o_orderkey AS id, {_KEYWORDS} || CASE WHEN o_orderkey % 10 < 9 THEN '|(고객|' || o_custkey || ')' ELSE '' END AS keywords FROM orders")
def x_keywords(t: Tables) -> DataFrame:
    return _questions(t).select("id", F.array_join(nlq.question_keywords(F.col("q"), nlq.diseases(F.col("q"))), "|").alias("keywords"))


@P.add(f"SELECT id, array_to_string(list_filter(string_split_regex(regexp_replace(q, '[^0-9A-Za-z_가-힣\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2), '|') AS keywords FROM {QV}")
def x_keywords_simple(t: Tables) -> DataFrame:
    return _questions(t).select("id", F.array_join(text.keywords(F.col("q"), []), "|").alias("keywords"))


@P.add(f"""
WITH c AS (SELECT id, length(regexp_replace(q, '[^가-힣]', '', 'g')) AS ko, length(regexp_replace(q, '[^A-Za-z]', '', 'g')) AS en FROM {QV}) SELECT id, CASE WHEN ko > en THEN 'ko' WHEN en > 0 THEN 'en' ELSE 'ko' END AS lang FROM c""")
def x_language(t: Tables) -> DataFrame:
    return _questions(t).select("id", text.language_by_count(F.col("q")).alias("lang"))


@P.add("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before, length(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS last_length FROM conversations")
def x_batch(t: Tables) -> DataFrame:
    """Each turn with what was said before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("n_before"), F.length(F.lag("text").over(w)).cast("long").alias("last_length"))


_AMOUNT = "list_transform(regexp_extract_all(q, '[0-9,]+\\s*[천만억조]\\s*원?'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')::BIGINT * CASE WHEN contains(m, '천') THEN 1000 WHEN contains(m, '만') THEN 10000 WHEN contains(m, '억') THEN 100000000 ELSE 1000000000000 END)"


@P.add(f"SELECT id, array_to_string({_AMOUNT}, ',') AS amounts FROM {QV}")
def x_amount_q(t: Tables) -> DataFrame:
    return _questions(t).select("id", F.array_join(nlq.amounts(F.col("q")).cast("array<string>"), ",").alias("amounts"))


@P.add(f"SELECT id, CASE WHEN NOT regexp_matches(q, '이하|미만') THEN ({_AMOUNT})[-1] END::BIGINT AS least, CASE WHEN regexp_matches(q, '이하|미만') THEN ({_AMOUNT})[-1] END::BIGINT AS most FROM {QV}")
def x_parse_bounds(t: Tables) -> DataFrame:
    return _questions(t).select("id", nlq.bounds(F.col("q")).alias("b")).select("id", "b.least", "b.most")


_PERIOD = "list_transform(regexp_extract_all(q, '[0-9]+\\s*(?:년|개월|월|주|일)'), lambda m: regexp_extract(m, '[0-9]+')::INT * CASE WHEN contains(m, '년') THEN 365 WHEN contains(m, '월') THEN 30 WHEN contains(m, '주') THEN 7 ELSE 1 END)"


@P.add(f"SELECT id, array_to_string({_PERIOD}, ',') AS days FROM {QV}")
def x_period_query(t: Tables) -> DataFrame:
    return _questions(t).select("id", F.array_join(nlq.periods(F.col("q")).cast("array<string>"), ",").alias("days"))


@P.add(f"SELECT o_orderkey AS id, unnest(CASE o_orderkey % 10 WHEN 4 THEN ['C' || {_C}, 'I21.9'] WHEN 6 THEN ['C' || {_C}] ELSE [] END) AS code FROM orders")
def x_kcd_query(t: Tables) -> DataFrame:
    return _questions(t).select("id", F.explode(nlq.kcd_codes(F.col("q"))).alias("code"))


@P.add("SELECT p_partkey AS id, unnest(CASE p_partkey % 2 WHEN 0 THEN ['C' || (p_partkey % 20 + 10) || '-C' || (p_partkey % 50 + 40), 'D05'] ELSE ['I' || (p_partkey % 40 + 10) || '-I' || (p_partkey % 40 + 50)] END) AS code FROM part")
def x_kcd_range(t: Tables) -> DataFrame:
    """A code with a Hangul syllable at its end is a part of a word."""
    rows = _parts(t, _case("p_partkey", "'C' || (p_partkey % 20 + 10) || '-C' || (p_partkey % 50 + 40) || ' , D05 및 C73은'", "'(I' || (p_partkey % 40 + 10) || '-' || (p_partkey % 40 + 50) || ')'"))
    return rows.select("id", F.explode(nlq.kcd_ranges(F.col("q"))).alias("code"))


@P.add("""
SELECT o_orderkey AS id, '대기기간@0' AS conditions FROM orders WHERE o_orderkey % 10 = 3
UNION ALL SELECT -1 - p_partkey, '면책기간@' || n || ',가입나이@' || (n + 6) || ',계약일@' || (n + 13) FROM (SELECT p_partkey, length(p_partkey::VARCHAR) AS n FROM part)""")
def x_conditions(t: Tables) -> DataFrame:
    more = t.part.select((-1 - F.col("p_partkey")).alias("id"), F.expr("p_partkey || '면책기간과 가입나이 및 계약일'").alias("q"))
    return _questions(t).unionByName(more).select("id", F.array_join(nlq.conditions(F.col("q")), ",").alias("conditions")).filter("conditions <> ''")


@P.add("SELECT o_orderkey AS id, '암진단특약' AS coverages FROM orders WHERE o_orderkey % 10 = 8")
def x_coverages(t: Tables) -> DataFrame:
    return _questions(t).select("id", F.explode(nlq.coverages(F.col("q"))).alias("coverages"))


@P.add("SELECT o_orderkey AS id, '갑상선암' AS disease FROM orders WHERE o_orderkey % 10 IN (0, 2)")
def x_diseases(t: Tables) -> DataFrame:
    """Two characters before the ending are the least, so 간암 is none."""
    return _questions(t).select("id", F.explode(nlq.diseases(F.col("q"))).alias("disease"))


_FOUND = _case(
    "o_orderkey", "'disease:갑상선암'", "''", "'disease:갑상선암'", f"'days:' || {_D}", f"'code:C' || {_C} || ',code:I21.9,amount:' || {_N} * 100000000", "''", f"'code:C' || {_C}", "''", f"'amount:' || {_N} * 1000 || ',days:' || {_N} * 365 || ',days:180,days:14'", "''",
)


@P.add(f"SELECT o_orderkey AS id, {_FOUND} AS entities FROM orders")
def x_entities_all(t: Tables) -> DataFrame:
    q = F.col("q")
    found = F.concat(F.transform(nlq.diseases(q), lambda x: F.concat(F.lit("disease:"), x)), F.transform(nlq.kcd_codes(q), lambda x: F.concat(F.lit("code:"), x)), F.transform(nlq.amounts(q), lambda x: F.concat(F.lit("amount:"), x.cast("string"))), F.transform(nlq.periods(q), lambda x: F.concat(F.lit("days:"), x.cast("string"))))
    return _questions(t).select("id", F.array_join(found, ",").alias("entities"))


# Extraction with places


@P.add(f"""
SELECT p_partkey AS id, unnest(r.value)::INT AS value, unnest(r.found) AS found FROM (SELECT p_partkey, {_case("p_partkey",
  f"{{'value': [{_PN} * 100000000 + 50000000, 50000000, 500], 'found': [{_PN} || '억 5천만원', '5천만원', '500원']}}", f"{{'value': [{_PN} * 100000000, {_PN} * 10000000, 200000000], 'found': [{_PN} || '억원', {_PN} || '천만원', '2억원']}}",
  f"{{'value': [{_PN} * 100000000 + 50000, 50000, {_PN} * 10000000, {_PN} * 100000000 + 5000000, 5000000], 'found': [{_PN} || '억 5만원', '5만원', {_PN} || ',000만원', {_PN} || '억 5백만원', '5백만원']}}", "NULL", "NULL")} AS r FROM part) WHERE r IS NOT NULL""")
def x_amount_doc(t: Tables) -> DataFrame:
    found = parsers.mapped(_legal(t), ["id"], "q", "value bigint, place int, found string", parsers.amounts)
    return found.select("id", F.col("value").cast("int").alias("value"), "found")


@P.add(f"SELECT p_partkey AS id, unnest({_case('p_partkey', '[50000000, 500]', f'[{_PN} * 100000000, {_PN} * 10000000, 200000000]', f'[{_PN} * 100000000 + 50000, {_PN} * 10000000]', '[]', '[]')})::INT AS value FROM part")
def x_amount_span(t: Tables) -> DataFrame:
    return parsers.mapped(_legal(t), ["id"], "q", "value bigint, place int, found string", parsers.amounts_by_span).select("id", F.col("value").cast("int").alias("value"))


@P.add(f"SELECT p_partkey AS id, unnest({_case('p_partkey', f'[{_PD}]', f'[{_PN} * 365, 180, 14, 1]', '[]', '[]', '[]')})::INT AS days FROM part")
def x_period(t: Tables) -> DataFrame:
    return parsers.mapped(_legal(t), ["id"], "q", "days int, place int, found string", parsers.periods).select("id", "days")


@P.add("SELECT id, len(regexp_extract_all(coalesce(q, ''), '[0-9]+\\s*(?:년|개월|주|일)'))::INT AS n FROM " + CV)
def x_period_nodedupe(t: Tables) -> DataFrame:
    return _legal(t).select("id", F.regexp_count(F.coalesce("q", F.lit("")), F.lit(r"[0-9]+\s*(?:년|개월|주|일)")).alias("n"))


@P.add(f"SELECT p_partkey AS id, {_PA}::INT AS article, '암진단급여금 지급' AS title, i::INT AS paragraph, i = 2 AS has_exception FROM part, range(1, 4) r(i) WHERE p_partkey % 5 = 0")
def x_legal_parse(t: Tables) -> DataFrame:
    found = parsers.mapped(_legal(t), ["id"], "q", "article int, title string, paragraph int, body string, has_exception boolean", parsers.legal_structure)
    return found.select("id", "article", "title", "paragraph", "has_exception")


@P.add("SELECT p_partkey AS id, '다만' AS keyword FROM part WHERE p_partkey % 5 = 0")
def x_exceptions(t: Tables) -> DataFrame:
    return parsers.mapped(_legal(t), ["id"], "q", "place int, keyword string", parsers.exceptions).select("id", "keyword")


@P.add("""
SELECT id, round(greatest(0, least(1, 1 - least(0.5, 0.1 * e) - least(0.2, 0.05 * w) - CASE WHEN parsed < 0.5 THEN 0.2 WHEN parsed < 0.8 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS confidence
FROM (SELECT p_partkey AS id, p_size % 12 AS e, p_partkey % 6 AS w, p_size / 50.0 AS parsed FROM part)""")
def x_legal_conf(t: Tables) -> DataFrame:
    """Parts as parsed texts with errors, warnings and the share that was parsed."""
    return t.part.select(F.col("p_partkey").alias("id"), nlq.parse_confidence(F.col("p_size") % 12, F.col("p_partkey") % 6, F.col("p_size") / 50).alias("confidence"))


@P.add("""
SELECT id, code, CASE WHEN code[1] = 'C' OR (code[1] = 'D' AND code[2] < '5') THEN 'cancer' WHEN code[1] = 'I' THEN 'cardiovascular' WHEN code[1] = 'E' THEN 'endocrine' ELSE 'unknown' END AS category
FROM (SELECT p_partkey AS id, chr((65 + p_partkey % 26)::INT) || (p_partkey * 7 % 90 + 10) AS code FROM part)""")
def x_kcd_category(t: Tables) -> DataFrame:
    """The first prefix in order: I6 codes count as I."""
    return _parts(t, "chr(65 + p_partkey % 26) || (p_partkey * 7 % 90 + 10)").select("id", F.col("q").alias("code"), nlq.code_category(F.col("q")).alias("category"))


_POLICIES = [("무배당 암보험", "cancer"), ("뇌졸중 보험", "cardiovascular"), ("종신", "life"), ("연금", "annuity"), ("간병", "disability"), ("실손", "health"), ("사고", "accident"), ("치과", "dental"), ("요양", "long_term_care"), ("적금", "savings"), ("기타", None)]
_INSURANCES = [("암보험 상품", "cancer"), ("건강 플랜", "health"), ("질병 사망", "health"), ("Term LIFE", "life"), ("재해", "accident"), ("간병", "long_term_care"), ("자동차", "unknown")]


def _named_parts(t: Tables, names: list[tuple]) -> DataFrame:
    return _parts(t, _case("p_partkey", *[f"'{n} ' || p_name" for n, _ in names]))


@P.add(_drawn("kind", [(i, k) for i, (_, k) in enumerate(_POLICIES)], "p_partkey", "part"))
def x_policy_category(t: Tables) -> DataFrame:
    return _named_parts(t, _POLICIES).select("id", nlq.first_family(F.col("q"), nlq.POLICY_WORDS).alias("kind"))


@P.add(_drawn("kind", [(i, k) for i, (_, k) in enumerate(_INSURANCES)], "p_partkey", "part"))
def x_insurance_type(t: Tables) -> DataFrame:
    return _named_parts(t, _INSURANCES).select("id", F.coalesce(nlq.first_family(F.col("q"), nlq.INSURANCE_WORDS), F.lit("unknown")).alias("kind"))


@P.add(_drawn("name, codes", [(0, "암", "C"), (0, "위암", "C16"), (0, "뇌출혈", "I60,I61,I62"), (1, "당뇨", "E10,E11,E12,E13,E14"), (1, "고혈압", "I10,I11,I12,I13,I15"), (2, None, None)], "p_partkey", "part") + " WHERE name IS NOT NULL")
def x_link_names(t: Tables) -> DataFrame:
    """A short list of names is an array, so no join is needed."""
    rows = _parts(t, _case("p_partkey", "p_name || ' 위암과 뇌출혈 진단'", "'당뇨 또는 고혈압 ' || p_name", "'골절 ' || p_name"))
    return rows.select("id", F.explode(nlq.linked_codes(F.col("q"))).alias("x")).select("id", "x.name", F.array_join("x.codes", ",").alias("codes"))


@P.add(_drawn("value, match_score, match_method", [(0, "Thyroid cancer", 1.0, "exact"), (1, "Liver cancer", 1.0, "kcd"), (2, "Thyroid cancer", 26 / 28, "fuzzy"), (3, None, 0.0, "none")], "c_custkey", "customer"))
def x_link_exact(t: Tables) -> DataFrame:
    """By name, by code within the text, and else by the closest name of at least 0.8."""
    known = t.spark.createDataFrame([("Thyroid cancer", "C73"), ("Liver cancer", "C22")], "value string, code string").withColumn("name", F.col("value"))
    asked = t.customer.select(F.col("c_custkey").alias("id"), F.expr(_case("c_custkey", "'thyroid CANCER'", "c_name || ' C22'", "'thyroid cancre'", "'nothing ' || c_name")).alias("q"))
    return fuzzy.linked(asked, known, "q", "name", "value", "code").drop("q")


#: An ontology of two entities for each part; names of seven and codes of ninety are shared by many.
ONTOLOGY = """'{"' || p_type || '": {"subtypes": {"a": {"standard": "질환' || p_partkey || '", "korean_names": ["병' || p_partkey || '"], "english_names": ["Cancer ' || (p_partkey % 7) || '"], "kcd_codes": ["C' || (p_partkey % 90 + 10) || '"], "severity": "minor"},
"b": {"standard": "증상' || p_partkey || '", "kcd_codes": ["D' || (p_partkey % 90 + 10) || '"]}}}}'"""


def _ontology(t: Tables) -> DataFrame:
    return ontology.entities(_parts(t, ONTOLOGY), "q", "id")


@P.add("""
SELECT 'name' AS kind, '질환' || p_partkey AS key, '질환' || p_partkey AS standard_name FROM part UNION ALL SELECT 'name', '병' || p_partkey, '질환' || p_partkey FROM part UNION ALL SELECT 'name', '증상' || p_partkey, '증상' || p_partkey FROM part
UNION ALL SELECT 'name', 'cancer ' || (p_partkey % 7), '질환' || max(p_partkey) FROM part GROUP BY 2 UNION ALL SELECT 'code', 'C' || (p_partkey % 90 + 10), '질환' || max(p_partkey) FROM part GROUP BY 2 UNION ALL SELECT 'code', 'D' || (p_partkey % 90 + 10), '증상' || max(p_partkey) FROM part GROUP BY 2""")
def src_yaml_ontology(t: Tables) -> DataFrame:
    """Indexes by lower-case name and by code in which the entity loaded last counts."""
    known = _ontology(t)
    names, codes = ontology.by_name(known), ontology.by_code(known)
    return names.select(F.lit("name").alias("kind"), F.col("name").alias("key"), "standard_name").unionByName(codes.select(F.lit("code").alias("kind"), F.col("code").alias("key"), "standard_name"))


def _score_of(text_: str) -> str:
    """SQL of a text's quality."""
    share = lambda pattern: f"(100 * length(regexp_replace({text_}, '{pattern}', '', 'g')) / length({text_}))"
    meant, special = share("[^가-힣A-Za-z]"), share(r"[\\p{L}\\p{N}_\\s\\x0B\\p{Z}]".replace("\\\\", "\\"))
    return f"""(CASE WHEN length({text_}) = 0 THEN 0 ELSE CASE WHEN length({text_}) >= 500 THEN 40 WHEN length({text_}) >= 200 THEN 30 WHEN length({text_}) >= 100 THEN 20 WHEN length({text_}) >= 50 THEN 10 ELSE 0 END
+ CASE WHEN {meant} >= 70 THEN 30 WHEN {meant} >= 50 THEN 20 WHEN {meant} >= 30 THEN 10 ELSE 0 END + CASE WHEN {special} < 10 THEN 20 WHEN {special} < 20 THEN 15 WHEN {special} < 30 THEN 10 WHEN {special} < 50 THEN 5 ELSE 0 END
+ CASE WHEN regexp_matches({text_}, '[■□○●◎◇◆△▲▽▼]{{3,}}|[\\x00-\\x1F]{{2,}}|�') THEN 0 ELSE 10 END END)"""


@P.add(f"""
WITH s AS (SELECT doc_id, {_score_of("substr(text, 1, 150)")} AS a, {_score_of("text")} AS b FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, CASE WHEN a >= 80 OR (b < 80 AND a >= b) THEN 'first' ELSE 'second' END AS algorithm, CASE WHEN a >= 80 OR (b < 80 AND a >= b) THEN a ELSE b END::INT AS score FROM s)
SELECT doc_id, algorithm, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' WHEN score >= 20 THEN 'poor' ELSE 'very_poor' END AS level FROM c""")
def src_pdf(t: Tables) -> DataFrame:
    """The best of three extractions of each document, its beginning, its text, and one without pages: the first excellent one, of equal ones the first."""
    tried = lambda name, of, pages: F.struct(F.lit(name).alias("algorithm"), of.alias("text"), F.lit(pages).alias("pages"))
    attempts = F.array(tried("none", F.col("text"), 0), tried("first", F.substring("text", 1, 150), 1), tried("second", F.col("text"), 1))
    return t.documents.filter("text is not null").select("doc_id", text.best_extraction(attempts).alias("b")).select("doc_id", "b.*")


@P.add("""
SELECT p_type AS category, 2 * count(*) AS entities, 2 * count(DISTINCT p_partkey % 90) AS codes, 'minor' AS severities FROM part GROUP BY p_type""")
def x_ontology_lookups(t: Tables) -> DataFrame:
    return ontology.stats(_ontology(t))


@P.add(f"""
SELECT p_partkey AS id, unnest(CASE p_partkey % 3 WHEN 0 THEN ['coverage_item', 'period'] WHEN 1 THEN ['benefit_amount', 'deductible', 'rider', 'eligibility', 'article'] ELSE [] END) AS kind,
unnest(CASE p_partkey % 3 WHEN 0 THEN ['입원', (p_partkey % 80 + 10) || '일'] WHEN 1 THEN [{_PN} || '0,000원', {_PN} || '0,000원', '암수술', '만 15세 ~ 만 60세', {_PA}::VARCHAR] ELSE [] END) AS label FROM part""")
def x_rule_entities(t: Tables) -> DataFrame:
    """Ten types of entities by pattern lists, each label of a type once."""
    rows = _parts(t, _case("p_partkey", f"'제' || {_PN} || '조 입원 보장 ' || (p_partkey % 80 + 10) || '일'", f"'자기부담금 ' || {_PN} || '0,000원, 암수술 특약, 만 15세 ~ 만 60세, 제' || {_PA} || '조'", "''"))
    return parsers.mapped(rows, ["id"], "q", "kind string, label string, context string", parsers.entities).drop("context")


@P.add("SELECT p_partkey AS id, p_name AS subject, p_type AS object, CASE p_partkey % 3 WHEN 0 THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence FROM part WHERE p_partkey % 3 < 2")
def x_relation_json(t: Tables) -> DataFrame:
    """What a model said of each part: with words around the JSON, without a confidence, or nothing."""
    body = """'{"relations": [{"subject": "' || p_name || '", "object": "' || p_type || '\""""
    rows = _parts(t, _case("p_partkey", f"""'x ```json' || chr(10) || {body}, "confidence": 0.9}}]}}' || chr(10) || '``` y'""", f"{body}}}]}}'", "'none'"))
    parsed = F.from_json(F.regexp_extract("q", r"(?s)(\{.*\})", 1), "relations array<struct<subject:string,object:string,confidence:double>>")
    return rows.select("id", F.explode(parsed["relations"]).alias("r")).select("id", "r.subject", "r.object", F.coalesce("r.confidence", F.lit(0.85)).alias("confidence"))


@P.add("""
SELECT id, CASE WHEN days IN (30, 45) THEN days ELSE 30 END AS days, CASE WHEN m > 0.1 * amount THEN NULL WHEN abs(700 - amount) = m THEN 700 WHEN abs(1000 - amount) = m THEN 1000 ELSE 1300 END AS amount
FROM (SELECT p_partkey AS id, p_size AS days, round(p_retailprice)::INT AS amount, least(abs(700 - round(p_retailprice)::INT), abs(1000 - round(p_retailprice)::INT), abs(1300 - round(p_retailprice)::INT)) AS m FROM part)""")
def x_relation_validate(t: Tables) -> DataFrame:
    """A period that the text does not name becomes the first one named; an amount becomes the nearest named one within a tenth, else it is an error (null)."""
    named = lambda *xs: F.array(*[F.lit(x) for x in xs])
    amount = F.round("p_retailprice").cast("int")
    return t.part.select(F.col("p_partkey").alias("id"), nlq.named_period(F.col("p_size"), named(30, 45)).alias("days"), nlq.named_amount(amount, named(700, 1000, 1300)).alias("amount"))


@P.add("SELECT id, confidence, confidence < 0.7 AS retry FROM (SELECT p_partkey AS id, round((p_size / 50.0 + p_partkey % 10 / 10.0) / 2 - least(0.3, 0.1 * (p_partkey % 5)), 6)::DOUBLE AS confidence FROM part)")
def x_relation_conf(t: Tables) -> DataFrame:
    value = nlq.relation_confidence(F.col("p_size") / 50, F.col("p_partkey") % 10 / 10, F.col("p_partkey") % 5)
    return t.part.select(F.col("p_partkey").alias("id"), value.alias("confidence"), (value < 0.7).alias("retry"))


# Chunks


@P.add("SELECT doc_id, len(regexp_extract_all(text, '[^.!?]+[.!?]+'))::INT AS n FROM documents")
def c_sentence_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.sentences(F.col("text"))).alias("n"))


@P.add()
def c_sentence(t: Tables) -> DataFrame:
    """Packed sentences; tests hold them against a fold in Python."""
    return t.documents.select("doc_id", F.posexplode(text.packed(text.sentences(F.col("text")), 1000)).alias("chunk_index", "chunk"))


@P.add("""
SELECT doc_id, count(*) AS n, sum(length(c))::BIGINT AS chars FROM (SELECT doc_id, trim(substr(text, i::INT, 1000), ' ') AS c FROM documents, unnest(generate_series(1, greatest(length(text), 1), 900)) s(i)) WHERE c <> '' GROUP BY doc_id""")
def c_size(t: Tables) -> DataFrame:
    chunks = t.documents.select("doc_id", F.explode(text.windows(F.col("text"), 1000, 900)).alias("c"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("c")).alias("chars"))


@P.add("SELECT id, md5(list[1]) AS first, md5(right(list[1], 100) || chr(10) || '...' || chr(10) || list[2]) AS second FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS list FROM documents) WHERE len(list) > 1")
def c_overlap(t: Tables) -> DataFrame:
    lines = t.documents.select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("x")).filter("size(x) > 1")
    over = lines.select("id", text.overlapped(F.col("x"), 100).alias("x"))
    return over.select("id", F.md5(F.encode(F.get("x", F.lit(0)), "UTF-8")).alias("first"), F.md5(F.encode(F.get("x", F.lit(1)), "UTF-8")).alias("second"))


_CONTRACT = f"'머리말 제1조 목적 이 약관은 ' || p_name || '. 제' || {_PA} || '조 정의 보험금은. 제3장 지급 제4조 지급 사유.'"


@P.add(f"""
SELECT p_partkey AS id, unnest([0, 1, 2, 3])::INT AS place, unnest(['제1조 목적 이 약관은 ' || p_name || '. ', '제' || {_PA} || '조 정의 보험금은. ', '제3장 지급 ', '제4조 지급 사유.']) AS chunk, unnest(['article', 'article', 'chapter', 'article']) AS kind FROM part""")
def c_article(t: Tables) -> DataFrame:
    rows = _parts(t, _CONTRACT).select("id", F.posexplode(text.articles(F.col("q"))).alias("place", "chunk"))
    return rows.withColumn("kind", text.chunk_type(F.col("chunk")))


@P.add("SELECT * FROM (SELECT 'article' AS kind, 3 * count(*) AS n FROM part UNION ALL SELECT 'chapter', count(*) FROM part)")
def c_type(t: Tables) -> DataFrame:
    return c_article(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@P.add()
def c_main(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(text.chunked(F.col("text"))).alias("chunk_index", "chunk"))


@P.add("""
SELECT p_partkey AS id, unnest([0, 1, 2, 3])::INT AS chunk, unnest(['article', 'chapter', 'article', 'article']) AS kind, unnest([0, 1, 3, 4])::INT AS line_start, unnest([0, 2, 3, 5])::INT AS line_end,
unnest(['머리말 ' || p_name, '제1조 목적' || chr(10) || '이 약관은', '제2장 지급', '제3조 사유' || chr(10) || p_type]) AS body FROM part""")
def c_semantic(t: Tables) -> DataFrame:
    rows = _parts(t, "'머리말 ' || p_name || chr(10) || '제1조 목적' || chr(10) || '이 약관은' || chr(10) || '제2장 지급' || chr(10) || '제3조 사유' || chr(10) || p_type")
    return parsers.mapped(rows, ["id"], "q", "chunk int, kind string, line_start int, line_end int, body string", parsers.semantic_chunks)


@P.add("SELECT p_partkey AS id, unnest([0, 1, 2])::INT AS chunk, unnest([false, true, false]) AS is_table, unnest([1, 1, 3])::INT AS parts, unnest([1304 + p_partkey % 50, 9, 1765])::INT AS length FROM part")
def c_structure(t: Tables) -> DataFrame:
    """A table stands alone, a heading closes what is large enough, and a small rest joins the chunk before."""
    blocks = ["'제1조 ' || repeat('가', 1300 + p_partkey % 50)", "'| a | b |'", "'제2조 ' || repeat('나', 100)", "'제3조 ' || repeat('다', 1600)", "'제4조 ' || repeat('라', 50)"]
    rows = _parts(t, " || chr(10) || chr(10) || ".join(blocks).replace("p_partkey % 50", "CAST(p_partkey % 50 AS INT)"))
    found = parsers.mapped(rows, ["id"], "q", "chunk int, is_table boolean, parts int, body string", parsers.structural_chunks)
    return found.select("id", "chunk", "is_table", "parts", F.length("body").alias("length"))


@P.add("SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS md FROM region")
def c_table_md(t: Tables) -> DataFrame:
    rows = t.region.groupBy().agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("x"))
    cells = F.concat(F.array(F.array(F.lit("r_regionkey"), F.lit("r_name"))), F.transform("x", lambda r: F.array(r["r_regionkey"].cast("string"), r["r_name"])))
    return rows.select(text.table_markdown(cells).alias("md"))


@P.add()
def c_sent_period(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.packed(F.split("text", r"\. "), 2048, ". ")).alias("n"))


@P.add("SELECT doc_id, ceil(length(text) / 4000)::BIGINT AS n FROM documents WHERE length(text) > 0")
def r_fixed_chunk(t: Tables) -> DataFrame:
    return t.documents.filter(F.length("text") > 0).select("doc_id", F.size(F.transform(F.sequence(F.lit(1), F.length("text"), F.lit(4000)), lambda i: F.substring("text", i, F.lit(4000)))).cast("long").alias("n"))


# Hashes and similarity


@P.add("SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def s_hash(t: Tables) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", F.sha2(raw, 256).alias("sha"), F.md5(raw).alias("md"))


@P.add("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def s_dedup_hash(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@P.add("""
WITH n AS (SELECT source, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) SELECT source, count(*) FILTER (k > 1) AS cached, count(*) AS total, round(count(*) FILTER (k > 1) / count(*) * 0.7, 6)::DOUBLE AS saving FROM n GROUP BY source""")
def s_cache_ratio(t: Tables) -> DataFrame:
    first = t.documents.select("source", "doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"))
    known = first.groupBy("h").agg(F.min("doc_id").alias("first"))
    cached = F.count_if(F.col("doc_id") != F.col("first"))
    return first.join(known, "h").groupBy("source").agg(cached.alias("cached"), F.count(F.lit(1)).alias("total"), F.round(cached / F.count(F.lit(1)) * 0.7, 6).alias("saving"))


@P.add("SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def src_cache(t: Tables) -> DataFrame:
    """Hashes that a cache would have answered."""
    return t.documents.groupBy(F.md5(F.encode("text", "UTF-8")).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _versions(t: Tables) -> DataFrame:
    """Each document beside a newer version: with a line added, the same, or with its first line changed, by the remainder of its id by three. A null text is an empty one, which has no lines."""
    text = F.coalesce("text", F.lit(""))
    longer = F.when(text == "", "added line").otherwise(F.concat(text, F.lit("\nadded line")))
    newer = F.when(F.col("doc_id") % 3 == 0, longer).when(F.col("doc_id") % 3 == 1, text).otherwise(F.concat(F.lit("changed "), text))
    return t.documents.select("doc_id", "text", newer.alias("newer"))


@P.add()
def s_ratio(t: Tables) -> DataFrame:
    """Each turn of a conversation against the one before by the same role."""
    before = F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    pairs = t.conversations.withColumn("before", before).filter("before is not null and text is not null")
    return parsers.compared(pairs, ["conv_id", "turn"], "before", "text").select("conv_id", "turn", "ratio", (F.col("ratio") >= 0.85).alias("same_version"))


@P.add("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END::BIGINT AS added, CASE WHEN doc_id % 3 = 2 AND text <> '' THEN 1 ELSE 0 END::BIGINT AS removed FROM documents")
def s_diff(t: Tables) -> DataFrame:
    return parsers.line_changes(_versions(t), "doc_id", "text", "newer").select("doc_id", "added", "removed")


@P.add("""
WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1.0 / (n + 1) WHEN 1 THEN 0 ELSE (CASE WHEN text = '' THEN 1.0 ELSE 2.0 END) / greatest(n, 1) END AS changed FROM (SELECT doc_id, text, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n FROM documents WHERE text IS NOT NULL))
SELECT doc_id, CASE WHEN changed > 0.3 THEN 'full' ELSE 'incremental' END AS mode, round(1 - changed, 6)::DOUBLE AS saving FROM c""")
def s_incremental(t: Tables) -> DataFrame:
    """A changed line counts as one added and one removed."""
    found = parsers.line_changes(_versions(t).filter("text is not null"), "doc_id", "text", "newer")
    return found.select("doc_id", F.when(F.col("change_ratio") > 0.3, "full").otherwise("incremental").alias("mode"), F.round(1 - F.col("change_ratio"), 6).alias("saving"))


@P.add()
def s_similar_docs(t: Tables) -> DataFrame:
    """For every fiftieth document the five of its language that are most alike, at least by half, held against all documents of the language."""
    found = ratios.most_alike(t.documents, "doc_id", "lang", F.col("doc_id") % 50 == 0, 0.5, 5)
    return found.withColumn("ratio", F.round("ratio", 6))


@P.add("""
SELECT p_brand, 0 AS place, '제1조 목적' AS line FROM part GROUP BY p_brand HAVING count(*) > 1 UNION ALL SELECT p_brand, 2, '1. 보험금' FROM part GROUP BY p_brand HAVING count(*) > 1
UNION ALL SELECT p_brand, 3, '제9조 ' || min(p_type) FROM part GROUP BY p_brand HAVING count(*) > 1 AND count(DISTINCT p_type) = 1""")
def s_template_common(t: Tables) -> DataFrame:
    """Headings and numbered lines of a brand's first contract that all its other contracts hold, white space aside, in order."""
    docs = _parts(t, "'제1조 목적' || chr(10) || p_name || chr(10) || '1. 보험금' || chr(10) || '제9조 ' || p_type", "p_brand").select(F.col("id").alias("doc_id"), F.col("q").alias("text"), "p_brand")
    return text.common_lines(docs, "p_brand")


@P.add(f"""
SELECT p_partkey AS id, unnest(['article:제' || {_PA} || '조(지급)', 'other:1. ', 'amount:' || {_PN} || '0,000원', 'percentage:5%', 'days:' || {_PD} || '일', 'months:6개월', 'years:' || {_PN} || '년']) AS variable FROM part""")
def s_template_vars(t: Tables) -> DataFrame:
    rows = _parts(t, f"'제' || {_PA} || '조(지급) 1. ' || {_PD} || '일 동안 3.5% 이율로 ' || {_PN} || '0,000원, 6개월 또는 ' || {_PN} || '년'")
    return rows.select("id", F.explode(text.template_variables(F.col("q"))).alias("variable"))


@P.add()
def s_template_match(t: Tables) -> DataFrame:
    """All documents against the template of their source: its first text, variable parts as placeholders."""
    known = t.documents.filter("text is not null").groupBy(F.col("source").alias("of")).agg(F.min_by("text", "doc_id").alias("first"))
    known = known.select("of", text.template_of(F.col("first")).alias("template"))
    found = t.documents.join(known, F.col("source").eqNullSafe(F.col("of")), "left")
    return found.select("doc_id", "source", text.template_score(F.col("template"), F.col("text")).alias("share"))


@P.add("""
SELECT id, CASE WHEN template >= 0.8 THEN 'template' WHEN ratio >= 0.85 AND changed <= 0.3 THEN 'incremental' ELSE 'chunking' END AS strategy, CASE WHEN template >= 0.8 THEN 0.95 WHEN ratio >= 0.85 AND changed <= 0.3 THEN round(1 - changed, 6) ELSE 0 END::DOUBLE AS saving
FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 0 THEN p_size / 50.0 END AS template, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 20 + 81) / 100.0 END AS ratio, (p_partkey % 7) / 10.0 AS changed FROM part)""")
def s_strategy(t: Tables) -> DataFrame:
    """Parts as documents with the score of a template and with a former version, if there is one."""
    k = F.col("p_partkey")
    template, ratio = F.when(k % 4 > 0, F.col("p_size") / 50), F.when(k % 5 > 0, (k % 20 + 81) / 100)
    return t.part.select(k.alias("id"), text.learning_strategy(template, ratio, k % 7 / 10).alias("s")).select("id", "s.*")


# Quality


_Q = """
WITH n AS (SELECT doc_id, text, length(text) AS n, 100 * length(regexp_replace(text, '[^가-힣A-Za-z]', '', 'g')) / length(text) AS meant, 100 * length(regexp_replace(text, '[\\p{L}\\p{N}_\\s\\x0B\\p{Z}]', '', 'g')) / length(text) AS special FROM documents WHERE text <> ''),
s AS (SELECT doc_id, CASE WHEN n >= 500 THEN 40 WHEN n >= 200 THEN 30 WHEN n >= 100 THEN 20 WHEN n >= 50 THEN 10 ELSE 0 END + CASE WHEN meant >= 70 THEN 30 WHEN meant >= 50 THEN 20 WHEN meant >= 30 THEN 10 ELSE 0 END
  + CASE WHEN special < 10 THEN 20 WHEN special < 20 THEN 15 WHEN special < 30 THEN 10 WHEN special < 50 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(text, '[■□○●◎◇◆△▲▽▼]{3,}|[\\x00-\\x1F]{2,}|�') THEN 0 ELSE 10 END AS score FROM n UNION ALL SELECT doc_id, 0 FROM documents WHERE text = '')
SELECT doc_id, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' WHEN score >= 20 THEN 'poor' ELSE 'very_poor' END AS level FROM s"""


@P.add(_Q)
def txt_quality(t: Tables) -> DataFrame:
    scored = t.documents.filter("text is not null").select("doc_id", text.text_quality(F.col("text"), F.lit(1)).alias("score"))
    return scored.select("doc_id", "score", text.quality_level(F.col("score")).alias("level"))


@P.add("""
WITH n AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^가-힣]', '', 'g')) / length(text) AS hangul, length(regexp_replace(text, '[^┌┐└┘│─┼┬┴├┤]', '', 'g')) AS tables, len(regexp_extract_all(text, '제[0-9]+조')) < 2 AND NOT regexp_matches(text, '제[0-9]+장') AS plain,
  length(regexp_replace(text, '[\\p{L}\\p{N}\\s\\x0B\\p{Z}]', '', 'g')) / length(text) AS special, coalesce(list_avg(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0B\\p{Z}]')), lambda x: length(x))), 0) AS line FROM documents WHERE text <> '')
SELECT doc_id, least(CASE WHEN hangul < 0.2 THEN 35 WHEN hangul < 0.4 THEN 20 ELSE 0 END + CASE WHEN tables > 50 THEN 25 WHEN tables > 20 THEN 15 ELSE 0 END + CASE WHEN plain THEN 20 ELSE 0 END + CASE WHEN special > 0.4 THEN 15 WHEN special > 0.3 THEN 10 ELSE 0 END + CASE WHEN line < 10 THEN 10 ELSE 0 END, 100)::INT AS score
FROM n UNION ALL SELECT doc_id, 100 FROM documents WHERE text = ''""")
def txt_complexity(t: Tables) -> DataFrame:
    return t.documents.filter("text is not null").select("doc_id", text.complexity(F.col("text")).alias("score"))


_STRUCTURED = "repeat('제1장 총칙 ', CAST(p_partkey % 9 AS INT)) || repeat('제2조 정의 ', p_size) || p_name"


@P.add(f"""
SELECT id, round(0.6 * length(regexp_replace(q, '[^가-힣]', '', 'g')) / greatest(length(q), 1) + 0.4 * least((2 * len(regexp_extract_all(q, '제[0-9]+장')) + len(regexp_extract_all(q, '제[0-9]+조'))) / 50, 1), 3)::DOUBLE AS score
FROM (SELECT p_partkey AS id, {_STRUCTURED} AS q FROM part)""")
def txt_struct_quality(t: Tables) -> DataFrame:
    """Texts of some chapters and articles around a part's name."""
    return _parts(t, _STRUCTURED).select("id", text.structure_quality(F.col("q")).alias("score"))


@P.add(f"SELECT doc_id, CASE WHEN score >= 70 THEN 'ocr' ELSE 'simple' END AS smart, CASE WHEN strlen(text) > 5242880 THEN 'ocr' ELSE 'simple' END AS by_size FROM ({ORACLES['txt_complexity']}) JOIN documents USING (doc_id)")
def src_pdf_hybrid(t: Tables) -> DataFrame:
    route = lambda strategy: text.extraction_route(F.lit(strategy), F.octet_length("text"), F.col("text"))
    return t.documents.filter("text is not null").select("doc_id", route("smart").alias("smart"), route("simple").alias("by_size"))


# Personal data

def _kinds_sql(form: str) -> str:
    return ", ".join(form.format(kind=k, pattern=p.replace("'", "''")) for k, p in pii.PATTERNS.items())


@P.add("SELECT * FROM (SELECT doc_id, " + _kinds_sql("len(regexp_extract_all(text, '{pattern}'))::INT AS {kind}") + " FROM documents) WHERE " + " + ".join(pii.PATTERNS) + " > 0")
def p_detect(t: Tables) -> DataFrame:
    """How many values of each kind a document has."""
    found = t.documents.select("doc_id", pii.detected(F.col("text")).alias("x")).filter("size(x) > 0")
    return found.select("doc_id", *[F.coalesce(F.size(F.col("x")[k]), F.lit(0)).alias(k) for k in pii.PATTERNS])


@P.add("SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in pii.PATTERNS.values()) + " AS found FROM documents")
def p_contains(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", pii.contains_pii(F.col("text")).alias("found"))


#: A value of each kind for each customer, and what is left of it. The expressions are SQL of both engines.
_FOUR = lambda x: f"lpad(CAST({x} % 10000 AS STRING), 4, '0')"
_SIX = "lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0')"
PII_VALUES = {
    "email": "'user' || c_custkey || '@example.com'", "phone": f"'010-' || {_FOUR('c_custkey')} || '-' || {_FOUR('c_custkey * 7')}", "ssn": f"'900101-' || (c_custkey % 4 + 1) || {_SIX}",
    "credit_card": f"'1234-5678-' || {_FOUR('c_custkey')} || '-' || {_FOUR('c_custkey * 3')}", "bank_account": f"'110-123-' || {_SIX}", "ip_address": "'10.' || (c_custkey % 256) || '.0.' || (c_custkey % 100)",
}
PII_MASKED = {
    "email": "'u' || repeat('*', length(CAST(c_custkey AS STRING)) + 2) || right(CAST(c_custkey AS STRING), 1) || '@example.com'", "phone": f"'010-****-' || {_FOUR('c_custkey * 7')}", "ssn": "'900101-' || (c_custkey % 4 + 1) || '******'",
    "credit_card": f"'****-****-****-' || {_FOUR('c_custkey * 3')}", "bank_account": f"'110-***-******' || right({_SIX}, 3)", "ip_address": "'10.' || (c_custkey % 256) || '.***.***'",
}


def _masked(name: str, kind: str) -> None:
    """One query for each mask; every fifth value is none of the kind."""

    def query(t: Tables) -> DataFrame:
        value = F.expr(f"CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE {PII_VALUES[kind]} END")
        return t.customer.select("c_custkey", pii.MASKS[kind](value).alias("masked"))

    query.__name__ = name
    P.add(f"SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE {PII_MASKED[kind]} END AS masked FROM customer")(query)


for _name, _kind in (("email", "email"), ("phone", "phone"), ("ssn", "ssn"), ("card", "credit_card"), ("account", "bank_account"), ("ip", "ip_address")):
    _masked(f"p_mask_{_name}", _kind)


@P.add("SELECT * FROM (" + " UNION ALL ".join(f"SELECT c_custkey, '{k}' AS kind, {PII_VALUES[k]} AS value, {v} AS masked FROM customer" for k, v in PII_MASKED.items()) + ")")
def p_masks(t: Tables) -> DataFrame:
    """All kinds of each customer."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(v).alias("value"), pii.MASKS[k](F.expr(v)).alias("masked")) for k, v in PII_VALUES.items()])
    return t.customer.select("c_custkey", F.inline(kinds))


@P.add("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1] || repeat('*', length(w) - 1)), ' ') AS masked FROM part")
def p_mask_name(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", pii.masked_name(F.col("p_name")).alias("masked"))


def _said(values: dict[str, str]) -> str:
    return f"'call ' || {values['phone']} || ' or ' || {values['email']} || ' from ' || {values['ip_address']} || ' card ' || {values['credit_card']} || ' id ' || {values['ssn']}"


@P.add(f"SELECT c_custkey, {_said(PII_MASKED)} AS masked FROM customer")
def p_mask_text(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", pii.masked_text(F.expr(_said(PII_VALUES))).alias("masked"))


@P.add("SELECT c_custkey, substr(c_name, 1, 1) || repeat('*', length(c_name) - 1) AS name, '[REDACTED]' AS token FROM customer")
def p_sanitize(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", pii.masked_name(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("token"))
    return rows.select(*pii.redacted_fields(rows.columns))


@P.add("SELECT c_custkey, '[REDACTED]' AS password FROM customer")
def p_redact(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_name").alias("password"))
    return rows.select(*pii.redacted_fields(rows.columns))


@P.add("SELECT c_custkey, c_name AS name FROM customer")
def p_encrypt(t: Tables) -> DataFrame:
    """A round trip: what is encrypted comes back."""
    key = "0123456789abcdef"
    return t.customer.select("c_custkey", pii.encrypted(F.col("c_name"), key).alias("e")).select("c_custkey", pii.decrypted(F.col("e"), key).alias("name"))


@P.add("SELECT c_custkey, sha256(c_name || 'pepper') AS h, md5(c_name) AS m FROM customer")
def p_hash(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", pii.salted_hash(F.col("c_name"), "pepper").alias("h"), F.md5(F.encode("c_name", "UTF-8")).alias("m"))


@P.add("SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS safe FROM pages")
def i_sanitize(t: Tables) -> DataFrame:
    return parsers.mapped(t.pages, ["page_id"], "html", "text string", parsers.nfkc).select("page_id", pii.escaped(F.col("text")).alias("safe"))


_INPUTS = [
    (1, "x UNION y SELECT z"), (2, "plain"), (3, "<script>alert(1)</script>"), (4, "../../etc/passwd"), (5, "a'; drop TABLE b;"), (6, "SELECT * FROM users"), (7, "1 OR 1=1"), (8, "'; DROP TABLE users--"), (9, "UNION SELECT password FROM users"), (10, "UPDATE t SET x"),
    (11, "a /* b"), (12, "x AND 2 = 2"), (13, "<img onload = x>"), (14, "<iframe src=x>"), (15, "a..b"), (16, "%2e%2e%2f"),
]


#: Which sign each input shows: of SQL injection, of a script, of a path.
_SIGNS = [(0, None, None), (None, None, None), (None, 0, None), (None, None, 0), (5, None, None), (1, None, None), (7, None, None), (5, None, None), (0, None, None), (3, None, None), (6, None, None), (8, None, None), (None, 2, None), (None, 3, None), (None, None, 1), (None, None, 2)]


@P.add(_drawn("sqli, xss, path", [(i, *x) for i, x in enumerate(_SIGNS)], "event_id", "events"))
def i_sqli(t: Tables) -> DataFrame:
    """Inputs of each kind with an event's type behind."""
    rows, q = t.events.select(F.col("event_id").alias("id"), F.concat(F.get(F.array(*[F.lit(x) for _, x in _INPUTS]), (F.col("event_id") % len(_INPUTS)).cast("int")), F.lit(" "), "event_type").alias("q")), F.col("q")
    return rows.select("id", pii.first_matching(q, pii.SQL_INJECTION).alias("sqli"), pii.first_matching(q, pii.XSS).alias("xss"), pii.first_matching(q, pii.PATH_TRAVERSAL).alias("path"))


@P.add("SELECT page_id, regexp_matches(url, '^https?://[A-Za-z0-9.-]+(:[0-9]+)?(/\\S*)?$') AS ok, left(regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '[^A-Za-z0-9가-힣._-]', '_', 'g'), 255) AS file FROM pages")
def i_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", pii.valid_url(F.col("url")).alias("ok"), pii.safe_filename(F.col("url")).alias("file"))


@P.add("SELECT c_custkey, c_custkey % 3 = 0 AS email, c_custkey % 3 = 1 AS phone FROM customer")
def i_email_phone(t: Tables) -> DataFrame:
    value = F.expr(_case("c_custkey", PII_VALUES["email"], PII_VALUES["phone"], "c_name"))
    return t.customer.select("c_custkey", pii.valid_email(value).alias("email"), pii.valid_phone(value).alias("phone"))


@P.add("SELECT conv_id, turn, length(text) <= 1000 AS query_ok, length(text) <= 10000 AS input_ok FROM conversations")
def i_length(t: Tables) -> DataFrame:
    n = F.length("text")
    return t.conversations.select("conv_id", "turn", (n <= 1000).alias("query_ok"), (n <= 10_000).alias("input_ok"))


# Formats


_WON = "CAST(round(o_totalprice) AS BIGINT) * (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 100000000 ELSE 0 END) + o_orderkey % 9999"


@P.add(f"""
SELECT id, CASE WHEN w >= 100000000 AND w % 100000000 = 0 THEN w // 100000000 || '억원' WHEN w >= 100000000 THEN w // 100000000 || '억 ' || w % 100000000 // 10000 || '만원' WHEN w >= 10000 THEN w // 10000 || '만원' ELSE format('{{:,}}', w) || '원' END AS shown
FROM (SELECT o_orderkey AS id, {_WON} AS w FROM orders)""")
def fmt_krw(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), text.krw(F.expr(_WON)).alias("shown"))


@P.add("SELECT p_partkey, CASE WHEN d >= 365 THEN (d // 365) || '년' WHEN d >= 30 THEN (d // 30) || '개월' ELSE d || '일' END AS shown FROM (SELECT p_partkey, p_size * p_size AS d FROM part)")
def fmt_period(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.period(F.col("p_size") * F.col("p_size")).alias("shown"))


# HTML


@P.add()
def src_html_text(t: Tables) -> DataFrame:
    return parsers.mapped(t.pages, ["page_id"], "html", "text string", parsers.html_text)


@P.add()
def src_html_links(t: Tables) -> DataFrame:
    found = parsers.mapped(t.pages, ["page_id"], "html", "href string, label string", parsers.html_links)
    return found.filter(F.contains(F.lower("href"), F.lit(".pdf")) | F.lower("label").rlike("pdf|약관") | F.col("href").startswith("/t"))


@P.add("SELECT p_partkey AS id, unnest([0, 1])::INT AS row, unnest(['name' || chr(9) || 'size', p_name || chr(9) || p_size]) AS cells FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 1, p_type FROM part WHERE p_partkey % 2 = 1")
def src_html_table(t: Tables) -> DataFrame:
    """A table of each part, within other markup or with an empty row."""
    pages = _case("p_partkey", "'<p>t</p><table><tr><th>name</th><th> size </th></tr><tr><td>' || p_name || '</td><td>' || p_size || '</td></tr></table>'", "'<table><tr></tr><tr><td>' || p_type || '</td></tr></table>'")
    return parsers.mapped(_parts(t, pages), ["id"], "q", "row int, cells string", parsers.html_tables)
