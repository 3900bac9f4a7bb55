"""Answers made from the rows that a question found, as columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldgraph.functions import answers, text

RESULTS = """array<struct<disease_name:string,coverage_name:string,amount:bigint,is_covered:boolean,coverages:array<string>,days:int,min_age:int,max_age:int,
product_name:string,description:string,body:string,item1:string,names1:array<string>,item2:string,names2:array<string>>>"""
# What is said where a result lacks something.
NOT_COVERED = "{disease_name}은(는) 현재 보장 대상이 아닙니다.\n\n보장받으시려면 다른 상품을 확인해보시기 바랍니다."
NO_EXCLUSIONS, NOTHING, FOUND = "제외되는 질병 정보를 찾을 수 없습니다.", "없음", "정보를 찾았습니다."
SOME_DISEASE, SOME_COVERAGE, SOME_PRODUCT, UNNAMED = "해당 질병", "해당 보장", "보험 상품", "알 수 없음"
# Format and confidence of the answer to each intent, of others and of none.
FORMS = {
    "coverage_amount": ("table", 0.9), "coverage_check": ("text", 0.95), "disease_comparison": ("comparison", 0.85), "coverage_comparison": ("comparison", 0.85),
    "exclusion_check": ("list", 0.9), "waiting_period": ("text", 0.95), "age_limit": ("text", 0.95), "product_summary": ("summary", 0.85),
}
GENERAL_FORM, NO_FORM, NO_EXCLUSIONS_FORM = ("text", 0.7), ("text", 0.0), ("text", 0.5)


def bullets(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda x: F.concat(F.lit("- "), x)), "\n")


def coverage_list(results: Column) -> Column:
    """A line for each coverage with its amount, if it has one."""
    amount = lambda r: F.when(F.coalesce(r["amount"], F.lit(0)) != 0, F.concat(F.lit(": "), F.format_number(r["amount"], 0), F.lit("원"))).otherwise("")
    return bullets(F.transform(results, lambda r: F.concat(F.coalesce(r["coverage_name"], F.lit(UNNAMED)), amount(r))))


def compared(name1: Column, names1: Column, name2: Column, names2: Column, shared: str = "공통 보장", own: str = "만 해당") -> Column:
    """Struct (similarities, differences) of two sets of names, in order."""
    said = lambda head, names: F.when(F.size(names) > 0, F.concat(head, F.lit(": "), F.array_join(F.array_sort(names), ", ")))
    lines = lambda *xs: text.let(F.array_compact(F.array(*xs)), lambda a: F.when(F.size(a) > 0, bullets(a)).otherwise(NOTHING))
    common = lines(said(F.lit(shared), F.array_intersect(names1, names2)))
    only = lines(said(F.concat(name1, F.lit(own)), F.array_except(names1, names2)), said(F.concat(name2, F.lit(own)), F.array_except(names2, names1)))
    return F.struct(common.alias("similarities"), only.alias("differences"))


def generated(intent: Column, query: Column, results: Column) -> Column:
    """Struct (answer, format, confidence) for an intent and its results (``RESULTS``)."""
    one, any_, said = F.get(results, F.lit(0)), F.size(results) > 0, lambda x, otherwise: F.coalesce(x, F.lit(otherwise))
    paid = F.filter(results, lambda r: (F.coalesce(r["coverage_name"], F.lit("")) != "") & (F.coalesce(r["amount"], F.lit(0)) != 0))
    named = F.filter(F.transform(results, lambda r: r["disease_name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    of_disease = F.coalesce(F.filter(one["coverages"], lambda x: F.coalesce(x, F.lit("")) != ""), F.array().cast("array<string>"))
    both = compared(one["item1"], one["names1"], one["item2"], one["names2"])
    comparison = {"item1_name": one["item1"], "item2_name": one["item2"], "similarities": both["similarities"], "differences": both["differences"]}
    # The total stands before the template's own unit, as its format does.
    variables = {
        "coverage_amount": {"disease_name": said(one["disease_name"], SOME_DISEASE), "coverage_list": coverage_list(paid), "total_amount": text.krw(F.aggregate(paid, F.lit(0).cast("long"), lambda s, r: s + r["amount"]))},
        "coverage_check": {"disease_name": said(one["disease_name"], SOME_DISEASE), "coverage_list": bullets(of_disease)},
        "disease_comparison": comparison,
        "coverage_comparison": comparison,
        "exclusion_check": {"exclusion_list": bullets(named)},
        "waiting_period": {"coverage_name": said(one["coverage_name"], SOME_COVERAGE), "days": said(one["days"], 0).cast("string")},
        "age_limit": {"min_age": said(one["min_age"], 0).cast("string"), "max_age": said(one["max_age"], 100).cast("string")},
        "product_summary": {"product_name": said(one["product_name"], SOME_PRODUCT), "description": said(one["description"], ""), "main_coverages": coverage_list(results)},
    }
    filled = lambda template, values: answers.rendered(F.lit(template), F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]))
    form = lambda answer, kind: F.struct(answer.alias("answer"), F.lit(kind[0]).alias("format"), F.lit(kind[1]).alias("confidence"))
    out = form(said(one["body"], FOUND), GENERAL_FORM)
    for name, values in variables.items():
        template = answers.TEMPLATES["disease_comparison" if name == "coverage_comparison" else name]
        answer = filled(template, values)
        if name == "coverage_check":
            answer = F.when(F.coalesce(one["is_covered"], F.lit(False)) & (F.size(of_disease) > 0), answer).otherwise(filled(NOT_COVERED, values))
        out = F.when(intent == name, form(answer, FORMS[name])).otherwise(out)
    none = form(answers.rendered(F.lit(answers.NO_RESULTS), F.create_map(F.lit("query"), query)), NO_FORM)
    return F.when(any_, out).when(intent == "exclusion_check", form(F.lit(NO_EXCLUSIONS), NO_EXCLUSIONS_FORM)).otherwise(none)
