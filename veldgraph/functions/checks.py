"""Checks of answers, of what was read from a document, and of the stages of ingestion, as columns of built-in functions.

A check that lacks its input (null) finds nothing. Severities are critical, error, warning and info.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldgraph.functions import compliance, nlq, text

# Amounts and codes in answers, words of doubt, words that are no topic, lengths of an answer.
AMOUNTS = [r"\d+억\s*\d*만?\s*원", r"\d+억\s*원", r"\d+천\s*만\s*원", r"\d+만\s*원", r"\d+천\s*원", r"\d+원"]
CODES = [r"[A-Z]\d{2,3}(?:-[A-Z]?\d{2,3})?"]
UNCERTAIN = ["아마도", "대략", "~것 같습니다", "추측", "가능성"]
STOPWORDS = ["은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "만"]
SHORTEST, LONGEST = 50, 5000
# Limits of amounts, days and confidence; of a text, an article and a vector; of an acceptable quality.
MOST_AMOUNT, MOST_DAYS, LEAST_CONFIDENCE = 10_000_000_000, 3650, 0.5
LEAST_CHARS, LEAST_ARTICLES, DIMENSION = 100, 1, 1536
ACCEPTABLE = 0.7

#: What each stage of ingestion counted; null if the stage has no result.
STAGES = """total_chars long, articles long, paragraphs long, subclauses long, empty_articles long, long_articles long, duplicate_articles long, entities long,
embeddings long, dim int, nodes long, article_nodes long, policy_nodes long, structural_nodes long"""


def _issue(condition: Column, **fields: str) -> Column:
    return F.when(condition, F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))


def _found(said: Column, patterns: list[str]) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(said, F.lit(p), F.lit(0)) for p in patterns]))


def answer_issues(question: Column, answer: Column, cited: Column, results: Column, least_sources: int = 1) -> Column:
    """Issues (stage, level) of an answer that cites node ids, against the results (node_id, text) it was made from."""
    texts = F.transform(results, lambda r: F.coalesce(r["text"], F.lit("")))
    joined = F.array_join(texts, " ")
    low = F.lower(answer)
    each = F.flatten(F.transform(texts, lambda x: _found(F.lower(x), AMOUNTS)))
    strange = lambda patterns: F.size(F.array_except(_found(answer, patterns), _found(joined, patterns))) > 0
    missing = compliance.completeness_issues(text.keywords(F.lower(question), STOPWORDS), answer, texts)
    issue = lambda stage, level, condition: _issue(condition, stage=stage, level=level)
    return F.array_compact(
        F.array(
            issue("source", "FAIL", F.size(cited) == 0),
            issue("source", "WARNING", (F.size(cited) > 0) & (F.size(cited) < least_sources)),
            issue("source", "FAIL", F.size(F.array_except(cited, F.transform(results, lambda r: r["node_id"]))) > 0),
            issue("facts", "WARNING", F.size(F.array_except(_found(low, AMOUNTS), each)) > 0),
            issue("facts", "WARNING", F.length(answer) < SHORTEST),
            issue("facts", "WARNING", F.length(answer) > LONGEST),
            issue("completeness", "WARNING", F.array_contains(missing, "exclusions")),
            issue("completeness", "WARNING", F.array_contains(missing, "query")),
            issue("invention", "FAIL", strange(AMOUNTS)),
            issue("invention", "FAIL", strange(CODES)),
            issue("invention", "WARNING", compliance.has_any(answer, UNCERTAIN)),
        )
    )


def answer_verdict(issues: Column, confidence: Column) -> Column:
    """Struct (level, confidence): the worst level, and the confidence less by every issue."""
    n = lambda level: F.size(F.filter(issues, lambda i: i["level"] == level))
    level = F.when(n("FAIL") > 0, "FAIL").when(n("WARNING") > 0, "WARNING").otherwise("PASS")
    return F.struct(level.alias("level"), nlq.validated_confidence(confidence, n("FAIL"), n("WARNING")).alias("confidence"))


def data_issues(articles: Column, amounts: Column, periods: Column, codes: Column, relations: Column, links: Column) -> Column:
    """Issues (category, severity, issue, n) of a document's articles (num, paragraphs), amounts, days, codes (code, is_valid), relations (subject, object, confidence) and links (mention, matched)."""
    n = lambda xs, f: F.size(F.filter(xs, lambda x: F.coalesce(f(x), F.lit(False))))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    none = lambda xs: (F.size(xs) == 0).cast("int")
    nums = F.transform(articles, lambda a: a["num"])
    paragraphs = F.flatten(F.transform(articles, lambda a: F.coalesce(a["paragraphs"], F.array().cast("array<string>"))))
    counts = [
        ("structure", "critical", "no articles", none(articles)),
        ("structure", "warning", "repeated articles", F.size(nums) - F.size(F.array_distinct(nums))),
        ("structure", "warning", "articles without paragraphs", n(articles, lambda a: F.coalesce(F.size(a["paragraphs"]), F.lit(0)) <= 0)),
        ("structure", "info", "empty paragraphs", n(paragraphs, blank)),
        ("data", "warning", "no data", (F.size(amounts) + F.size(periods) + F.size(codes) == 0).cast("int")),
        ("data", "error", "invalid amounts", n(amounts, lambda x: x <= 0)),
        ("data", "warning", "large amounts", n(amounts, lambda x: x > MOST_AMOUNT)),
        ("data", "error", "invalid periods", n(periods, lambda x: x <= 0)),
        ("data", "warning", "long periods", n(periods, lambda x: x > MOST_DAYS)),
        ("data", "warning", "invalid codes", n(codes, lambda x: ~F.coalesce(x["is_valid"], F.lit(False)))),
        ("relations", "warning", "no relations", none(relations)),
        ("relations", "error", "no subject", n(relations, lambda r: blank(r["subject"]))),
        ("relations", "error", "no object", n(relations, lambda r: blank(r["object"]))),
        ("relations", "info", "low confidence", n(relations, lambda r: F.coalesce(r["confidence"], F.lit(0.0)) < LEAST_CONFIDENCE)),
        ("entities", "warning", "no links", none(links)),
        ("entities", "info", "failed links", n(links, lambda x: x["matched"].isNull())),
    ]
    made = [F.when(count > 0, F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(i).alias("issue"), count.cast("long").alias("n"))) for c, s, i, count in counts]
    return F.array_compact(F.array(*made))


def link_rate(links: Column) -> Column:
    """The share of mentions that were linked; 0 of none."""
    return F.when(F.size(links) > 0, F.size(F.filter(links, lambda x: x["matched"].isNotNull())) / F.size(links)).otherwise(0.0)


def pipeline_report(dim: int = DIMENSION, prefix: str = "") -> Column:
    """Struct (checks, passed, ok, issues) of a row with the columns of ``STAGES``: fourteen checks, fewer where a stage has no result."""
    c = lambda name: F.col(prefix + name)
    parsed, graph = c("articles").isNotNull(), c("nodes").isNotNull()
    every = c("total_chars").isNotNull() & parsed & c("entities").isNotNull() & c("embeddings").isNotNull() & graph
    parts = c("articles") + c("paragraphs") + c("subclauses")
    checks = [
        ("completeness", "critical", "no text", c("total_chars").isNull()),
        ("completeness", "error", "short text", c("total_chars") < LEAST_CHARS),
        ("completeness", "critical", "not parsed", ~parsed),
        ("completeness", "error", "few articles", c("articles") < LEAST_ARTICLES),
        ("completeness", "warning", "no extraction", c("entities").isNull()),
        ("completeness", "warning", "no embeddings", F.coalesce(c("embeddings"), F.lit(0)) == 0),
        ("completeness", "critical", "no nodes", F.coalesce(c("nodes"), F.lit(0)) == 0),
        ("consistency", "warning", "nodes differ", every & (c("nodes") != 1 + parts + c("entities"))),
        ("consistency", "info", "embeddings differ", every & (c("embeddings") != parts)),
        ("consistency", "error", "dimension differs", every & (c("embeddings") > 0) & (c("dim") != dim)),
        ("consistency", "warning", "article nodes differ", every & (c("article_nodes") != c("articles"))),
        ("quality", "warning", "empty articles", parsed & (c("empty_articles") > 0)),
        ("quality", "info", "long articles", parsed & (c("long_articles") > 0)),
        ("quality", "error", "repeated articles", parsed & (c("duplicate_articles") > 0)),
        ("graph", "critical", "policy nodes", graph & (c("policy_nodes") != 1)),
        ("graph", "critical", "no structure", graph & (c("structural_nodes") == 0)),
    ]
    issues = F.array_compact(F.array(*[_issue(condition, category=a, severity=b, issue=i) for a, b, i, condition in checks]))
    n = F.lit(5) + F.when(every, 4).otherwise(0) + F.when(parsed, 3).otherwise(0) + F.when(graph, 2).otherwise(0)
    return F.struct(n.alias("checks"), (n - F.size(issues)).alias("passed"), (~_serious(issues)).alias("ok"), issues.alias("issues"))


def _serious(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"].isin("critical", "error"))


def report(issues: Column, quality: Column) -> Column:
    """Struct of all issues by severity, whether none is serious, and whether the quality suffices."""
    n = lambda severity: F.size(F.filter(issues, lambda i: i["severity"] == severity))
    return F.struct(F.size(issues).alias("total"), n("critical").alias("critical"), n("error").alias("errors"), n("warning").alias("warnings"), (~_serious(issues)).alias("valid"), (quality >= ACCEPTABLE).alias("acceptable"))
