"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is heavy. There can be no more heavy keys than this number.
SHARE = 1000
#: Rows of heavy keys up to so many bytes are broadcast; larger ones meet their keys' rows in so many parts.
SENT_BYTES = 32 << 20
PARTS = 64


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str = "size", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``size`` the key's number of rows; ``size`` is dropped.

    ``table`` should be stored, since it is read several times. Rows of heavy keys stay
    where they are and meet the broadcast part of the table, fewer than ``SHARE`` rows by
    the definition of heavy, if these are small by their size; else both sides are dealt
    into ``PARTS``, the table's rows into each. All other rows are shuffled. A ``left`` join
    keeps rows without a key in the table.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    heavy = table.filter(F.col(size) * SHARE > F.lit(total)).drop(size)
    light = table.filter(F.col(size) * SHARE <= F.lit(total)).drop(size)
    if heavy.isEmpty():
        return rows.join(light.hint("merge"), keys, how)
    names = heavy.select(*keys)
    apart = rows.join(F.broadcast(names), keys, "left_anti").join(light.hint("merge"), keys, how)
    # Keys are numbers, so their table is small; what comes with them may be texts.
    n_bytes = heavy.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if n_bytes <= SENT_BYTES:
        return rows.join(F.broadcast(heavy), keys).unionByName(apart)
    dealt = rows.join(F.broadcast(names), keys, "left_semi").withColumn("part_", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)).cast("int"))
    every = heavy.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(every.hint("merge"), [*keys, "part_"]).drop("part_").unionByName(apart)
