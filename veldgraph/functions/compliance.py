"""Rules over answers and their sources: citations, risk of invention, duty to explain, validation, matching. All are columns of built-in functions.

Citations are an array of structs (document_id string, text string, confidence double).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CITATIONS = "array<struct<document_id:string,text:string,confidence:double>>"
# Limits of a citation's text and of confidence.
LEAST_TEXT, MOST_TEXT, LEAST_CONFIDENCE = 10, 5000, 0.7
# What makes a statement definite.
DEFINITE = ["반드시", "절대", "100%", "전액", "무조건"]
# The words of each category of explanation, in the order in which they are tried.
CATEGORY_WORDS = [
    ("exclusion", ["면책", "제외", "안 되", "보장하지"]),
    ("waiting_period", ["대기기간", "대기 기간", "면책기간"]),
    ("reduction_period", ["감액", "50%"]),
    ("premium", ["보험료", "납입", "월납"]),
    ("cancellation", ["해지", "환급", "해약"]),
    ("coverage", ["보장", "지급", "담보"]),
]
# What an explanation of a category must hold one of.
REQUIRED_WORDS = {
    "coverage": ["보장", "지급", "담보"],
    "exclusion": ["면책", "제외", "보상하지 않", "보장하지 않"],
    "waiting_period": ["대기기간", "대기 기간", "면책기간", "면책 기간"],
    "reduction_period": ["감액기간", "감액 기간", "50%"],
    "premium": ["보험료", "납입", "월납"],
    "cancellation": ["해지", "환급금", "해약"],
}
# Words to be used with care, and words not to be used.
CAUTION_WORDS = ["전액", "100%", "무조건", "반드시", "모든"]
PROHIBITED_WORDS = ["무조건 가입", "100% 수익", "손해 없음", "위험 전혀 없음"]
# What sources say of exceptions.
EXCLUSION_WORDS = ["면책", "제외", "단", "다만", "except", "exclusion"]
# The steps of a document's status.
TRANSITIONS = {
    "discovered": ["queued", "ignored"],
    "queued": ["downloading", "failed", "ignored"],
    "downloading": ["processing", "failed"],
    "processing": ["completed", "failed"],
    "failed": ["queued", "ignored"],
    "completed": [],
    "ignored": ["discovered"],
}


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def citation_error(citation: Column) -> Column:
    """Why a citation is not valid; null if it is. An empty field is a missing one."""
    missing = lambda f: F.coalesce(citation[f], F.lit("")) == ""
    n = F.length(citation["text"])
    return (
        F.when(missing("document_id"), "Missing required field: document_id")
        .when(missing("text"), "Missing required field: text")
        .when(~citation["confidence"].between(0, 1), F.concat(F.lit("Invalid confidence score: "), citation["confidence"].cast("string")))
        .when(n < LEAST_TEXT, f"Citation text too short (< {LEAST_TEXT} characters)")
        .when(n > MOST_TEXT, f"Citation text too long (> {MOST_TEXT} characters)")
    )


def enough_citations(answer: Column, citations: Column, least: int = 1) -> Column:
    """A long answer needs two, a very long one three."""
    n = F.size(citations)
    return (n >= least) & ~((F.length(answer) > 500) & (n < 2)) & ~((F.length(answer) > 1000) & (n < 3))


def risk_points(answer: Column, citations: Column, least_confidence: float = LEAST_CONFIDENCE) -> Column:
    """Points for few citations, each weak one, many numbers without proof, and definite words."""
    n = F.size(citations)
    weak = F.size(F.filter(citations, lambda c: F.coalesce(c["confidence"] < least_confidence, F.lit(False))))
    numbers = F.regexp_count(answer, F.lit(r"\d{1,3}(?:,\d{3})*(?:\.\d+)?"))
    few = F.when(n == 0, 40).when((n == 1) & (F.length(answer) > 300), 20).otherwise(0)
    return few + 15 * weak + F.when((numbers > 3) & (n < 2), 15).otherwise(0) + F.when(has_any(answer, DEFINITE), 10).otherwise(0)


def risk_level(points: Column) -> Column:
    return F.when(points >= 50, "high").when(points >= 25, "medium").otherwise("low")


def trace(answer: Column, citations: Column) -> Column:
    """The report on an answer's sources: how many, how many valid, mean confidence, risk."""
    valid = F.size(F.filter(citations, lambda c: citation_error(c).isNull()))
    known = F.filter(F.transform(citations, lambda c: c["confidence"]), lambda c: c.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, c: s + c) / F.size(known)).otherwise(0.0)
    points = risk_points(answer, citations)
    return F.struct(F.size(citations).alias("citations"), valid.alias("valid"), F.round(mean, 6).alias("confidence"), points.alias("points"), risk_level(points).alias("risk"))


def category(question: Column, answer: Column) -> Column:
    """What has to be explained: the first category of which the question or the answer holds a word."""
    said = F.lower(F.concat_ws(" ", question, answer))
    out = F.lit("other")
    for name, words in reversed(CATEGORY_WORDS):
        out = F.when(has_any(said, words), name).otherwise(out)
    return out


def explained(answer: Column, kind: Column) -> Column:
    """Whether the answer holds a word that its category requires; another category requires none."""
    out = F.lit(True)
    for name, words in REQUIRED_WORDS.items():
        out = F.when(kind == name, has_any(answer, words)).otherwise(out)
    return out


def words_in(answer: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(answer, F.lit(w)), w) for w in words]))


def level(n_issues: Column, n_warnings: Column, risk: Column, valid: Column, explained_: Column) -> Column:
    return F.when((n_issues > 0) | (risk == "high") | ~valid, "fail").when((n_warnings > 0) | (risk == "medium") | ~explained_, "warning").otherwise("pass")


def completeness_issues(question_words: Column, answer: Column, sources: Column) -> Column:
    """``exclusions`` if the first five sources speak of exceptions and the answer does not; ``query`` if it holds no word of the question."""
    low, said = F.lower(answer), F.lower(F.array_join(F.slice(sources, 1, 5), " "))
    missing = F.when(has_any(said, EXCLUSION_WORDS) & ~has_any(low, EXCLUSION_WORDS), "exclusions")
    off = F.when((F.size(question_words) > 0) & ~F.exists(question_words, lambda w: F.contains(low, F.lower(w))), "query")
    return F.array_compact(F.array(missing, off))


def matching_score(age: Column, product: Column, has_same: Column, city: Column, n_consultations: Column) -> Column:
    """How well a product suits a customer, 0 to 100: age by kind of product, an equal product already held, a known city, frequent advice."""
    life = F.when(age.between(30, 50), 20).when(age > 50, 10).otherwise(0)
    health = F.when(age < 40, 25).when(age >= 40, 15).otherwise(0)
    points = 50 + F.when(product == "life", life).when(product == "health", health).otherwise(0) + F.when(has_same, -30).otherwise(15)
    points = points + F.when(F.coalesce(city, F.lit("")) != "", 5).otherwise(0) + F.when(n_consultations > 3, 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def allowed_step(before: Column, after: Column) -> Column:
    """Whether a status may follow another; an unknown one has no next."""
    out = F.lit(False)
    for k, nexts in TRANSITIONS.items():
        out = F.when(before == k, after.isin(nexts) if nexts else F.lit(False)).otherwise(out)
    return out
