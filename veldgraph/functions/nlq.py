"""Questions in natural language: intent, entities, routing and answers, as columns over a table of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldgraph.functions.text import let
from veldgraph.operators import graph

# Intents with their priority, patterns and keywords.
INTENTS = [
    ("coverage_amount", 3, ["보장금", "보험금", "지급", "얼마"], ["금액", "얼마", "보장금", "보험금"]),
    ("coverage_check", 3, ["보장", "커버", "포함", "해당"], ["보장", "되나요", "해당", "포함"]),
    ("exclusion_check", 3, ["제외", "면책", "보장안", "안되"], ["제외", "면책", "제외"]),
    ("waiting_period", 2, ["대기기간", "기다려야", "얼마나", "언제부터"], ["대기기간", "기간"]),
    ("coverage_inquiry", 2, ["무엇", "어떤", "뭘", "보장"], ["보장", "무엇", "어떤"]),
    ("condition_inquiry", 2, ["조건", "요건", "필요", "받으려면"], ["조건", "요건"]),
    ("product_summary", 1, ["요약", "설명", "개요", "소개"], ["요약", "설명"]),
]
LEAST_SCORE = 0.3
# Word families of the simple path, the first with a hit names the intent.
SIMPLE_INTENTS = [
    ("comparison", ["비교", "차이", "어떤게", "어느게", "vs"]),
    ("exclusion_check", ["면책", "제외", "안되는", "못받는", "불가"]),
    ("coverage_check", ["보장", "지급", "받을 수", "해당", "포함"]),
    ("period_check", ["기간", "대기", "경과", "후", "이내"]),
]
# An amount in a question.
SIMPLE_AMOUNT = r"[0-9]\s*억\s*([0-9]+\s*만\s*)?원|[0-9]\s*천\s*만\s*원|[0-9]\s*만\s*원|[0-9]\s*천\s*원|[0-9]\s*원"
# Words that are no keywords.
STOPWORDS = ["은", "는", "이", "가", "을", "를", "의", "에", "에서", "로", "으로", "과", "와", "도", "만", "까지", "부터", "뿐", "이나", "나", "하고", "이다", "있다", "없다", "되다", "하다", "그", "저", "것", "수", "등", "및"]
UNITS = {"천": 1_000, "만": 10_000, "억": 100_000_000, "조": 1_000_000_000_000}
DAYS = {"년": 365, "개월": 30, "월": 30, "주": 7, "일": 1}
# Conditions that a question may name.
CONDITIONS = ["대기기간", "면책기간", "나이제한", "연령제한", "가입나이", "최고나이", "최저나이", "보장개시일", "계약일"]
# Endings of disease names.
SUFFIXES = ["암", "종양", "질환", "질병", "증후군", "염", "출혈"]


def intent_score(question: Column, priority: int, patterns: list[str], words: list[str]) -> Column:
    hit = sum((F.contains(question, F.lit(p)).cast("int") for p in patterns), F.lit(0)) / len(patterns)
    said = sum((F.contains(question, F.lit(w)).cast("int") for w in words), F.lit(0)) / len(words)
    return F.round(0.5 * hit + 0.3 * said + 0.2 * min(priority / 5, 1.0), 6)


def intent_scores(question: Column) -> Column:
    """Intents with their scores, best first; of equal scores the higher priority, then the order of definition."""
    scored = [
        F.struct((-intent_score(F.lower(question), p, pats, words)).alias("order"), F.lit(-p).alias("priority"), F.lit(i).alias("place"), F.lit(name).alias("intent"), intent_score(F.lower(question), p, pats, words).alias("score"))
        for i, (name, p, pats, words) in enumerate(INTENTS)
    ]
    return F.array_sort(F.array(*scored))


def best_intent(question: Column) -> Column:
    """The first of ``intent_scores``; each score is computed once, without sorting them."""
    scored = lambda q: F.array(*[F.struct(intent_score(q, p, pats, words).alias("score"), F.lit(p).alias("priority"), F.lit(-i).alias("place"), F.lit(name).alias("intent")) for i, (name, p, pats, words) in enumerate(INTENTS)])
    return let(let(F.lower(question), lambda q: F.array_max(scored(q))), lambda first: F.when(first["score"] >= LEAST_SCORE, first["intent"]).otherwise("unknown"))


def is_complex(question: Column, gap: float = 0.2) -> Column:
    """The best two intents are close."""
    s = intent_scores(question)
    return F.get(s, F.lit(0))["score"] - F.get(s, F.lit(1))["score"] < gap


def simple_intent(question: Column) -> Column:
    """The first word family with a hit, else a filter by an amount, else a search."""
    out = F.when(question.rlike(SIMPLE_AMOUNT), "amount_filter").otherwise("search")
    for name, words in reversed(SIMPLE_INTENTS):
        hit = reduce(lambda a, b: a | b, [F.contains(F.lower(question), F.lit(w)) for w in words])
        out = F.when(hit, name).otherwise(out)
    return out


def query_type(intent: Column, n_diseases: Column, n_coverages: Column) -> Column:
    """Which engine a question goes to."""
    named = (n_diseases > 0) | (n_coverages > 0)
    return (
        F.when(intent.isin("disease_comparison", "coverage_comparison"), "graph_traversal")
        .when(named & intent.isin("coverage_amount", "coverage_check", "condition_inquiry"), "graph_traversal")
        .when(named, "hybrid")
        .when(intent.isin("general_info", "product_summary", "coverage_inquiry"), "vector_search")
        .when(intent.isin("waiting_period", "age_limit", "exclusion_check"), "direct_lookup")
        .otherwise("hybrid")
    )


def answerable(intent: Column, n_diseases: Column, n_coverages: Column) -> Column:
    """False for an unknown intent and where what the intent asks about is not named."""
    return (
        F.when(intent == "unknown", F.lit(False))
        .when(intent == "coverage_amount", (n_diseases > 0) | (n_coverages > 0))
        .when(intent.isin("coverage_check", "exclusion_check"), n_diseases > 0)
        .when(intent == "disease_comparison", n_diseases >= 2)
        .when(intent == "coverage_comparison", n_coverages >= 2)
        .otherwise(F.lit(True))
    )


def clarification(intent: Column, diseases_: Column, coverages_: Column) -> Column:
    """What to ask back; null if the question can be answered. ``diseases_`` and ``coverages_`` are the names found."""
    compared = lambda names, one, none: F.when(F.size(names) == 1, F.concat(F.get(names, F.lit(0)), F.lit(one))).otherwise(none)
    return (
        F.when(answerable(intent, F.size(diseases_), F.size(coverages_)), F.lit(None).cast("string"))
        .when(intent == "unknown", "질문을 좀 더 구체적으로 말씀해 주시겠어요?")
        .when(intent == "coverage_amount", "어떤 질병이나 보장에 대한 금액을 알고 싶으신가요?")
        .when(intent.isin("coverage_check", "exclusion_check"), "어떤 질병에 대해 확인하고 싶으신가요?")
        .when(intent == "disease_comparison", compared(diseases_, "와 어떤 질병을 비교하고 싶으신가요?", "어떤 질병들을 비교하고 싶으신가요?"))
        .when(intent == "coverage_comparison", compared(coverages_, "와 어떤 보장을 비교하고 싶으신가요?", "어떤 보장들을 비교하고 싶으신가요?"))
        .otherwise("질문을 좀 더 명확하게 말씀해 주시겠어요?")
    )


def question_keywords(question: Column, entities: Column, most: int = 10) -> Column:
    """Entities, then words that are no stopwords and in no entity, each once."""
    words = F.filter(F.split(F.trim(question), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS) & ~F.exists(entities, lambda e: F.contains(e, w)))
    return F.slice(F.array_distinct(F.concat(entities, words)), 1, most)


# Entities


def amounts(question: Column) -> Column:
    """Amounts of a number and one unit; compound units are not read here."""
    found = F.regexp_extract_all(question, F.lit(r"([0-9,]+)\s*([천만억조])\s*원?"), F.lit(0))
    unit = lambda m: reduce(lambda out, kv: out.when(F.contains(m, F.lit(kv[0])), kv[1]), UNITS.items(), F.when(F.lit(False), 0)).otherwise(1)
    return F.transform(found, lambda m: F.regexp_replace(m, "[^0-9]", "").try_cast("bigint") * unit(m))


def periods(question: Column) -> Column:
    """Periods in days."""
    found = F.regexp_extract_all(question, F.lit(r"([0-9]+)\s*(년|개월|월|주|일)"), F.lit(0))
    unit = lambda m: reduce(lambda out, kv: out.when(m.endswith(kv[0]), kv[1]), DAYS.items(), F.when(F.lit(False), 0)).otherwise(0)
    return F.transform(found, lambda m: F.regexp_extract(m, "[0-9]+", 0).try_cast("int") * unit(m))


def kcd_codes(text: Column) -> Column:
    """Disease codes; a Hangul syllable beside one makes it part of a word."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(?<!\w)[A-Z][0-9]{2,3}(?:\.[0-9]{1,2})?(?!\w)"), F.lit(0))


def kcd_ranges(text: Column) -> Column:
    """Single codes and ranges, these as start-end with the letter in both."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)(?<!\w)[A-Z][0-9]{2}(?:-[A-Z]?[0-9]{2})?(?!\w)"), F.lit(0))
    end = lambda m: F.when(F.contains(m, F.lit("-")), F.concat(F.substring(m, 1, 4), F.when(F.substring(m, 5, 1).rlike("[A-Z]"), F.substring(m, 5, 3)).otherwise(F.concat(F.substring(m, 1, 1), F.substring(m, 5, 2))))).otherwise(m)
    return F.transform(found, end)


def conditions(text: Column) -> Column:
    """keyword@place of the known conditions, by first place."""
    found = [F.when(F.instr(text, k) > 0, F.struct((F.instr(text, k) - 1).alias("at"), F.lit(k).alias("word"))) for k in CONDITIONS]
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda x: F.concat_ws("@", x["word"], x["at"]))


def _where(text: Column, endings: list[str], found: Column) -> Column:
    """``found`` in texts that hold one of the endings, nothing in others, which no pattern has to walk through; null texts stay null."""
    return F.when(text.isNull() | reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in endings]), found).otherwise(F.array().cast("array<string>"))


def coverages(text: Column) -> Column:
    """Names that end in 특약, 보장 or 담보."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\w+(?:특약|보장|담보)"), F.lit(0)), lambda w: F.length(w) >= 3))
    return _where(text, ["특약", "보장", "담보"], found)


def diseases(text: Column) -> Column:
    """Names that end as diseases do, ending by ending."""
    return F.array_distinct(F.concat(*[_where(text, [x], F.regexp_extract_all(text, F.lit(rf"(?U)\w{{2,}}{x}"), F.lit(0))) for x in SUFFIXES]))


def bounds(question: Column) -> Column:
    """(least, most): the last amount is a least one unless 이하 or 미만 is said."""
    last = F.element_at(amounts(question), -1)
    some = F.size(amounts(question)) > 0
    below = question.rlike("이하|미만")
    return F.struct(F.when(some & ~below, last).alias("least"), F.when(some & below, last).alias("most"))


# Answers


def answer(intent: Column, n_results: Column, total: Column) -> Column:
    return (
        F.when(n_results == 0, F.lit("관련 정보를 찾을 수 없습니다."))
        .when(intent == "coverage_amount", F.concat(F.lit("총 "), n_results.cast("string"), F.lit("개 보장, 합계 "), total.cast("string"), F.lit("원")))
        .when(intent == "coverage_check", F.concat(F.lit("네, 보장됩니다. ("), n_results.cast("string"), F.lit("개 보장)")))
        .otherwise(F.concat(n_results.cast("string"), F.lit("개의 결과를 찾았습니다.")))
    )


def answer_confidence(n_results: Column, has_path: Column, length: Column) -> Column:
    more = F.when(n_results >= 5, 0.3).when(n_results >= 3, 0.2).when(n_results >= 1, 0.1).otherwise(0.0)
    return F.round(F.least(0.5 + more + F.when(has_path, 0.1).otherwise(0.0) + F.when(length > 200, 0.1).otherwise(0.0), F.lit(1.0)), 6)


def validated_confidence(base: Column, n_fail: Column, n_warning: Column) -> Column:
    """Halved for each failure, a tenth less for each warning."""
    return F.round(base * F.pow(F.lit(0.5), n_fail) * F.pow(F.lit(0.9), n_warning), 6)


# Categories and links

# Code prefixes, word families and names, in the order in which they are tried.
CODE_CATEGORIES = [("cancer", ["C", "D0", "D1", "D2", "D3", "D4"]), ("cardiovascular", ["I"]), ("cerebrovascular", ["I6"]), ("endocrine", ["E"])]
INSURANCE_WORDS = [("cancer", ["암", "암보험", "cancer"]), ("health", ["건강", "건강보험", "질병"]), ("life", ["생명", "사망", "life"]), ("accident", ["상해", "재해", "accident"]), ("long_term_care", ["장기요양", "요양", "간병"])]
POLICY_WORDS = [
    ("cancer", ["암", "cancer", "종양"]), ("cardiovascular", ["심혈관", "뇌혈관", "심장", "뇌졸중"]), ("life", ["종신", "정기", "생명"]), ("annuity", ["연금", "펜션"]), ("disability", ["장애", "간병"]),
    ("health", ["건강", "의료", "실손"]), ("accident", ["상해", "사고"]), ("dental", ["치아", "치과"]), ("long_term_care", ["간병", "요양"]), ("savings", ["저축", "적금"]),
]
NAMED_CODES = {
    "암": ["C"], "일반암": ["C"], "소액암": ["C77"], "유사암": ["D0", "D1", "D2", "D3"], "위암": ["C16"], "간암": ["C22"], "폐암": ["C34"], "유방암": ["C50"], "심근경색": ["I21", "I22", "I23"],
    "뇌졸중": ["I60", "I61", "I62", "I63", "I64"], "뇌출혈": ["I60", "I61", "I62"], "뇌경색": ["I63"], "당뇨": ["E10", "E11", "E12", "E13", "E14"], "고혈압": ["I10", "I11", "I12", "I13", "I15"],
}


def code_category(code: Column) -> Column:
    """The first category of which the code has a prefix."""
    out = F.lit("unknown")
    for name, prefixes in reversed(CODE_CATEGORIES):
        out = F.when(reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes]), name).otherwise(out)
    return out


def first_family(text: Column, families: list[tuple[str, list[str]]]) -> Column:
    """The first family of words with one in the lower-case text; null if none has."""
    out = F.lit(None).cast("string")
    for name, words in reversed(families):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words]), name).otherwise(out)
    return out


def linked_codes(text: Column) -> Column:
    """(name, codes) of each known name in the text."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(n)), F.struct(F.lit(n).alias("name"), F.array(*[F.lit(c) for c in codes]).alias("codes"))) for n, codes in NAMED_CODES.items()]))


def parse_confidence(errors: Column, warnings: Column, parsed: Column) -> Column:
    """1 less a tenth for each error, half of it for each warning, and for what was not parsed, within bounds."""
    value = 1 - F.least(F.lit(0.5), 0.1 * errors) - F.least(F.lit(0.2), 0.05 * warnings) - F.when(parsed < 0.5, 0.2).when(parsed < 0.8, 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6)


def named_period(days: Column, named: Column) -> Column:
    """The period if the text names it, else the first one named."""
    return F.when(F.array_contains(named, days) | (F.size(named) == 0), days).otherwise(F.get(named, F.lit(0)))


def named_amount(amount: Column, named: Column, share: float = 0.1) -> Column:
    """The nearest named amount, if it is within a share; null if none is. Of two as near the first counts."""
    away = F.transform(named, lambda x, i: F.struct(F.abs(x - amount).alias("away"), i.alias("i"), x.alias("x")))
    best = F.array_min(away)
    return F.when(best["away"] <= share * amount, best["x"])


def relation_confidence(said: Column, found: Column, errors: Column) -> Column:
    return F.round((said + found) / 2 - F.least(F.lit(0.3), 0.1 * errors), 6)


def dispatch(analysis: dict, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph query of an analysed question; an intent that needs a disease without one is an error."""
    intent, disease = analysis.get("intent"), analysis.get("disease")
    if intent == "coverage_amount":
        if not disease:
            raise ValueError("coverage_amount needs a disease")
        return graph.coverage_amounts(nodes, edges, disease)
    if intent == "coverage_check":
        found = graph.coverage_check(nodes, edges)
        return found.filter(F.col("disease") == disease) if disease else found
    if intent == "comparison":
        if not disease or not analysis.get("other"):
            raise ValueError("comparison needs two diseases")
        return graph.comparison(nodes, edges, "Disease", "Coverage", disease, analysis["other"])
    return graph.of_label(nodes, "Coverage", "c").select(F.col("c_name").alias("coverage"), F.col("c_amount").alias("amount"))


# Codes and categories of diseases by name.
DISEASES = {"암": ("C00-C97", "암"), "뇌졸중": ("I60-I69", "뇌혈관질환"), "당뇨병": ("E10-E14", "내분비질환"), "심근경색": ("I21", "심혈관질환"), "급성심근경색증": ("I21", "심혈관질환")}


def known_disease(name: Column) -> Column:
    """Struct (name, code, category): the name without white space at its ends, and what is known of it."""
    plain = F.trim(name)
    of = lambda i: F.get(F.filter(F.array(*[F.when(plain == k, v[i]) for k, v in DISEASES.items()]), lambda x: x.isNotNull()), F.lit(0))
    return F.struct(plain.alias("name"), of(0).alias("code"), of(1).alias("category"))
