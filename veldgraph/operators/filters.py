"""Predicates: optional filters, wildcards, containment, arrays and full text. All are columns, so they reach the scan where Spark can push them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions that are given; true if none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def ilike_any(term: str, *columns: str) -> Column:
    """Contains, in either case, with ``%`` and ``_`` of the term as wildcards."""
    return any_of(*[F.col(c).ilike(f"%{term}%") for c in columns])


def lower_like_any(term: str, *columns: str) -> Column:
    return any_of(*[F.lower(c).like(f"%{term.lower()}%") for c in columns])


def contains_any(term: str, *columns: str) -> Column:
    """Contains, in either case and without wildcards."""
    return any_of(*[F.contains(F.lower(c), F.lit(term.lower())) for c in columns])


def age_between(birth_year: str, year: int, least: int | None = None, most: int | None = None) -> Column:
    """Bounds on age as bounds on the year of birth."""
    return all_of(F.col(birth_year) <= year - least if least is not None else None, F.col(birth_year) >= year - most if most is not None else None)


def within(value: Column, least: float | None, most: float | None) -> Column:
    """Both bounds inclusive; a missing bound is no bound."""
    return all_of(value >= least if least is not None else None, value <= most if most is not None else None)


def any_amount_between(amounts: str, least: float | None = None, most: float | None = None) -> Column:
    """Some element lies between the bounds, which are 0 and 999,999,999 if missing."""
    return F.exists(amounts, lambda a: a.between(0 if least is None else least, 999_999_999 if most is None else most))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def full_text(df: DataFrame, query: str, weights: dict[str, float]) -> DataFrame:
    """Rows that hold all words of the query in some weighted column, with ``rank``: the sum of weight times occurrences."""
    wanted = [w for w in query.lower().split() if w]
    fields = {c: tokens(F.coalesce(F.col(c), F.lit(""))) for c in weights}
    every = F.concat(*fields.values())
    count = lambda c: F.size(F.filter(fields[c], lambda t: t.isin(wanted)))
    rank = sum((count(c) * F.lit(w) for c, w in weights.items()), F.lit(0.0))
    return df.filter(all_of(*[F.array_contains(every, w) for w in wanted])).withColumn("rank", F.round(rank, 6))


def matches_keywords(keywords: list[str], *columns: str) -> Column:
    """Some column is one line that holds a keyword, in either case. Keywords are patterns, not literals."""
    pattern = r"(?i)\A[^\n]*(?:" + "|".join(keywords) + r")[^\n]*\z"
    return any_of(*[F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns])


def first_text(*columns: str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a total order; numbers begin at 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(total: Column, number: int, size: int) -> list[Column]:
    pages = F.ceil(total / size).cast("long")
    return [total.alias("total"), pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev")]
