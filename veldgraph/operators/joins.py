"""Joins that are more than one call: counts of children, pairs, missing edges, bands, spines and lookup cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.storage import stored


def with_child_count(parent: DataFrame, child: DataFrame, key: str, child_key: str, name: str, condition: Column | None = None) -> DataFrame:
    """All parents with the number of their children; children are counted before the join."""
    counted = (child if condition is None else child.filter(condition)).groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return parent.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


#: Pairs that one task makes, or so.
MADE = 2_000_000


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], spread: str) -> DataFrame:
    """The inner join, dealt by the number of pairs that keys make and not by the bytes of the sides, which may be few.

    Rows of a key with more than ``MADE`` pairs are split by the left column ``spread``,
    and those of its right side are sent to each split.
    """
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    made = stored(count(left, "n_").join(count(right, "m_"), on).select(*on, (F.col("n_") * F.col("m_")).alias("made_")), "made")
    total = made.agg(F.sum("made_")).first()[0] or 0
    own = left.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = max(int(own), -(-total // MADE))
    hot = made.filter(F.col("made_") > MADE).select(*on, F.ceil(F.col("made_") / MADE).alias("splits_"))
    if total > MADE and hot.limit(1).count():
        left = left.join(hot, on, "left").withColumn("split_", F.pmod(F.xxhash64(spread), F.coalesce("splits_", F.lit(1)))).drop("splits_")
        right = right.join(hot, on, "left").withColumn("split_", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("splits_", F.lit(1)) - 1))).drop("splits_")
        on = [*on, "split_"]
    return left.repartition(parts, *on).join(right.repartition(parts, *on), on).drop("split_")


def pairs(df: DataFrame, equal: list[str], id_col: str, residual: Column | None = None, ordered: bool = True) -> DataFrame:
    """Pairs of rows equal in some columns, once each if ``ordered``; columns get the suffixes _1 and _2. Tasks are dealt by the number of pairs."""
    own = [c for c in df.columns if c not in equal]
    left = df.select(*equal, *[F.col(c).alias(f"{c}_1") for c in own])
    right = df.select(*equal, *[F.col(c).alias(f"{c}_2") for c in own])
    a, b = F.col(f"{id_col}_1"), F.col(f"{id_col}_2")
    keep = a < b if ordered else a != b
    return dealt_join(left, right, equal, f"{id_col}_1").filter(keep if residual is None else keep & residual)


def first_pairs(df: DataFrame, equal: list[str], id_col: str, k: int) -> DataFrame:
    """The first k pairs of rows equal in some columns, in the order of both ids.

    A pair's first row is among the k least ids that a greater one of their group follows,
    so only these meet the table, where it is, and each task keeps k pairs.
    """
    last = df.groupBy(*equal).agg(F.max(id_col).alias("last_"))
    first = df.join(last, equal).filter(F.col(id_col) < F.col("last_")).orderBy(id_col).limit(k).select(*equal, F.col(id_col).alias(f"{id_col}_1"))
    both = df.select(*equal, F.col(id_col).alias(f"{id_col}_2")).join(F.broadcast(first), equal)  # k rows
    return both.filter(F.col(f"{id_col}_1") < F.col(f"{id_col}_2")).orderBy(f"{id_col}_1", f"{id_col}_2").limit(k)


def stars(df: DataFrame, equal: list[str], id_col: str = "id") -> DataFrame:
    """(src, dst): of rows equal in some columns, none null, the one of least id with each other one. As many edges as rows connect what all pairs would."""
    first = df.groupBy(*equal).agg(F.min(id_col).alias("src"))
    return df.select(*equal, F.col(id_col).alias("dst")).join(first, equal).filter("src <> dst").select("src", "dst")


def stars_across(df: DataFrame, equal: list[str], apart: str, id_col: str = "id") -> DataFrame:
    """The same between rows that differ in ``apart``: those beside the first row go to the first row elsewhere. Ends are in order."""
    first = df.groupBy(*equal).agg(F.min(id_col).alias("a_"), F.min_by(apart, id_col).alias("own_"))
    placed = df.select(*equal, apart, F.col(id_col).alias("id_")).join(first, equal)
    other = placed.filter(F.col(apart) != F.col("own_")).groupBy(*equal).agg(F.min("id_").alias("c_"))
    ends = placed.join(other, equal).filter("id_ <> a_").select(F.when(F.col(apart) != F.col("own_"), F.col("a_")).when(F.col(apart) == F.col("own_"), F.col("c_")).alias("x_"), "id_").filter("x_ is not null")
    return ends.select(F.least("x_", "id_").alias("src"), F.greatest("x_", "id_").alias("dst")).distinct()


#: Labels meet by parts of so many characters; shorter labels can't be contained.
PART = 3


def contained(df: DataFrame, label: str, id_col: str = "id", least: int = 4, equal: tuple[str, ...] = ()) -> DataFrame:
    """(equal columns, inner, inner_id, outer, outer_id) of the distinct lower-case labels of which one holds the other, among rows equal in some columns; ids are the least of a label.

    What holds a label holds all its parts, so a label looks for others by its rarest part
    only, and work follows the candidates of that part. A label of n characters has n parts.
    """
    if least < PART:
        raise ValueError(f"labels have {PART} characters or more")
    named = df.filter(F.length(label) >= least).groupBy(*equal, F.lower(label).alias("name_")).agg(F.min(id_col).alias("id_"))
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name_") - PART + 1), lambda i: F.substring("name_", i, F.lit(PART))))
    rows = stored(named.select(*equal, "name_", "id_", F.explode(parts).alias("part_")), "parts")
    counts = rows.groupBy(*equal, "part_").agg(F.count("*").alias("n_"))
    rarest = rows.join(counts, [*equal, "part_"]).groupBy(*equal, "name_", "id_").agg(F.min(F.struct("n_", "part_")).alias("least_"))
    inner = rarest.select(*equal, F.col("name_").alias("inner"), F.col("id_").alias("inner_id"), F.col("least_.part_").alias("part_"))
    outer = rows.select(*equal, F.col("name_").alias("outer"), F.col("id_").alias("outer_id"), "part_")
    return inner.join(outer, [*equal, "part_"]).filter((F.col("inner") != F.col("outer")) & F.contains("outer", "inner")).drop("part_")


def containing_rows(df: DataFrame, label: str, id_col: str, equal: tuple[str, ...], least: int = 4, tail: str = "") -> DataFrame:
    """(equal columns, id_1, id_2) of all rows of which the first's label, of ``least`` characters or more, is within the second's with ``tail`` behind it, in either case, among rows equal in some columns.

    Distinct labels meet by the rarest part of the inner one; rows meet by their labels then.
    """
    if least < PART:
        raise ValueError(f"labels have {PART} characters or more")
    rows = df.select(*equal, F.col(id_col).alias("id_"), F.lower(label).alias("name_"), (F.length(label) >= least).alias("long_")).filter("name_ is not null")
    named = rows.groupBy(*equal, "name_").agg(F.max("long_").alias("long_"))
    parts = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - PART + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(PART))))
    outer = stored(named.select(*equal, F.col("name_").alias("outer_"), F.explode(parts(F.concat("name_", F.lit(tail.lower())))).alias("part_")), "parts")
    counts = outer.groupBy(*equal, "part_").agg(F.count("*").alias("n_"))
    asked = named.filter("long_").select(*equal, F.col("name_").alias("inner_"), F.explode(parts(F.col("name_"))).alias("part_"))
    rarest = asked.join(counts, [*equal, "part_"]).groupBy(*equal, "inner_").agg(F.min(F.struct("n_", "part_")).alias("least_")).select(*equal, "inner_", F.col("least_.part_").alias("part_"))
    held = rarest.join(outer, [*equal, "part_"]).filter(F.contains(F.concat("outer_", F.lit(tail.lower())), F.col("inner_"))).select(*equal, "inner_", "outer_")
    within = rows.filter("long_").select(*equal, F.col("name_").alias("inner_"), F.col("id_").alias(f"{id_col}_1")).join(held, [*equal, "inner_"])
    around = rows.select(*equal, F.col("name_").alias("outer_"), F.col("id_").alias(f"{id_col}_2"))
    found = dealt_join(within.select(*equal, "outer_", f"{id_col}_1"), around, [*equal, "outer_"], f"{id_col}_1")
    return found.filter(F.col(f"{id_col}_1") != F.col(f"{id_col}_2")).select(*equal, f"{id_col}_1", f"{id_col}_2")


def containing(df: DataFrame, label: str, id_col: str = "id", least: int = 4) -> DataFrame:
    """(src, dst) of the first rows of labels of which one holds the other, in either case; ends are in order."""
    found = contained(df, label, id_col, least)
    return found.select(F.least("inner_id", "outer_id").alias("src"), F.greatest("inner_id", "outer_id").alias("dst")).distinct()


def undirected(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge once, its ends in order."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *keep).distinct()


def without_edge(found: DataFrame, edges: DataFrame, directed: bool = True, typed: bool = False) -> DataFrame:
    """Rows (src, dst and with ``typed`` rel_type) between which no edge runs yet; without direction, neither way."""
    key = ["src", "dst", "rel_type"] if typed else ["src", "dst"]
    if directed:
        return found.join(edges.select(*key).distinct(), key, "left_anti")
    ends = edges.select(F.least("src", "dst").alias("lo_"), F.greatest("src", "dst").alias("hi_"), *(["rel_type"] if typed else [])).distinct()
    marked = found.withColumns({"lo_": F.least("src", "dst"), "hi_": F.greatest("src", "dst")})
    return marked.join(ends, ["lo_", "hi_", *(["rel_type"] if typed else [])], "left_anti").drop("lo_", "hi_")


def band(left: DataFrame, right: DataFrame, equal: list[str], left_at: str, right_at: str, distance: int) -> DataFrame:
    """Rows with equal columns and places at most ``distance`` apart.

    Places are put in bins of that width; a left row meets three bins, so the join is on equality and its size follows the result.
    """
    bins = F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda d: F.floor(F.col(left_at) / distance) + d))
    a = left.withColumn("bin_", bins)
    b = right.withColumn("bin_", F.floor(F.col(right_at) / distance))
    return a.join(b, [*equal, "bin_"]).filter(F.abs(F.col(left_at) - F.col(right_at)) <= distance).drop("bin_")


def latest_prior(df: DataFrame, group: list[str], at: str, tie: str, payload: list[str]) -> DataFrame:
    """Each row with the columns ``payload`` of the row before it in its group, as ``prior_*``."""
    w = Window.partitionBy(*group).orderBy(at, tie)
    return df.withColumns({f"prior_{c}": F.lag(c).over(w) for c in payload})


def latest_per_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("rn_ = 1").drop("rn_")


def month_spine(stats: DataFrame, month: str, last: str, months: int, values: list[str]) -> DataFrame:
    """``months`` months up to that of ``last``, each with its values or zeros. The spine is built from the arguments alone."""
    spine = stats.sparkSession.range(months).select(F.add_months(F.trunc(F.lit(last).cast("date"), "month"), -F.col("id").cast("int")).alias(month))
    return spine.join(stats, month, "left").select(F.date_format(month, "yyyy-MM").alias(month), *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def lookup_cascade(df: DataFrame, lookups: list[tuple[DataFrame, str]], value: str, name: str) -> DataFrame:
    """``name`` is the value of the first lookup table (key column, value column) that knows the row's key; null if none does."""
    out = df
    for i, (table, key) in enumerate(lookups):
        out = out.join(table.select(F.col(key), F.col(value).alias(f"found_{i}_")).dropDuplicates([key]), key, "left")
    found = [F.col(f"found_{i}_") for i in range(len(lookups))]
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"found_{i}_" for i in range(len(lookups))])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
