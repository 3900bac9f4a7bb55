"""Answers from templates, and the quality of what was read from a document, as columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The answer to each intent; variables stand in braces.
TEMPLATES = {
    "coverage_amount": "{disease_name}의 경우 다음과 같이 보장됩니다:\n\n{coverage_list}\n\n총 {total_amount}원의 보장을 받으실 수 있습니다.",
    "coverage_check": "{disease_name}은(는) 보장 대상입니다.\n\n다음 보장에 포함됩니다:\n{coverage_list}",
    "exclusion_check": "다음 질병은 보장에서 제외됩니다:\n\n{exclusion_list}",
    "waiting_period": "{coverage_name}의 대기기간은 {days}일입니다.\n\n계약일로부터 {days}일 이후에 발생한 사고에 대해 보장받으실 수 있습니다.",
    "age_limit": "가입 가능 연령은 {min_age}세부터 {max_age}세까지입니다.",
    "disease_comparison": "{item1_name}과(와) {item2_name}의 보장 비교:\n\n**공통점:**\n{similarities}\n\n**차이점:**\n{differences}",
    "product_summary": "**{product_name}**\n\n{description}\n\n**주요 보장:**\n{main_coverages}",
}
GENERAL = "{answer}"
NO_RESULTS = "죄송합니다. {query}에 대한 정보를 찾을 수 없습니다.\n\n다른 질문을 해주시거나, 더 구체적으로 질문해주세요."
CHECKED = """id int, structure_valid boolean, critical_valid boolean, relations_valid boolean, entities_valid boolean, nodes_valid boolean, edges_valid boolean, consistent boolean, criticals int, errors int, warnings int,
orphans int, duplicates int, invalid int, nodes int, edges int, articles int, paragraphs int, amounts int, periods int, codes int, relations int, link_rate double"""
# The parts of the overall quality.
WEIGHTS = {"completeness": 0.3, "accuracy": 0.3, "consistency": 0.25, "coverage": 0.15}


def template(intent: Column, has_results: Column) -> Column:
    """The template of an intent, the general one for others; without results the apology."""
    out = F.lit(GENERAL)
    for k, text in TEMPLATES.items():
        out = F.when(intent == k, text).otherwise(out)
    return F.when(has_results, out).otherwise(NO_RESULTS)


def rendered(text: Column, variables: Column) -> Column:
    """A template with the values of a map in place of their names; a variable without a value stays."""
    return F.aggregate(F.map_entries(variables), text, lambda out, x: F.replace(out, F.concat(F.lit("{"), x["key"], F.lit("}")), F.coalesce(x["value"], F.lit(""))))


def _clamped(value: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6)


def _off(column: str, points: float) -> Column:
    return F.when(F.col(column), 0.0).otherwise(points)


def _some(column: str, points: float, many: int = 0, more: float = 0.0) -> Column:
    return F.when(F.col(column) > 0, points).otherwise(0.0) + (F.when(F.col(column) >= many, more).otherwise(0.0) if many else F.lit(0.0))


def quality() -> dict[str, Column]:
    """completeness, accuracy, consistency, coverage and overall, each 0 to 1, of rows of ``CHECKED``."""
    share = lambda a, b, points: F.col(a) / F.greatest(F.col(b), F.lit(1)) * points
    parts = {
        "completeness": 1 - _off("structure_valid", 0.3) - _off("critical_valid", 0.2) - _off("relations_valid", 0.2) - _off("entities_valid", 0.1) - _off("nodes_valid", 0.1) - _off("edges_valid", 0.1),
        "accuracy": 1 - F.col("criticals") * 0.3 - F.col("errors") * 0.1 - F.col("warnings") * 0.02,
        "consistency": 1 - _off("consistent", 0.4) - share("orphans", "nodes", 0.3) - share("duplicates", "nodes", 0.2) - share("invalid", "edges", 0.2),
        "coverage": _some("articles", 0.2, 10, 0.1) + _some("paragraphs", 0.1, 50, 0.1) + _some("amounts", 0.1) + _some("periods", 0.05) + _some("codes", 0.05) + _some("relations", 0.1, 10, 0.1) + F.col("link_rate") * 0.2,
    }
    parts = {k: _clamped(v) for k, v in parts.items()}
    return parts | {"overall": F.round(sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)), 6)}
