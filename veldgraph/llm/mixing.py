"""Mixing sources to target weights by hierarchical budgeting.

The columns of ``levels`` span a tree (domain, language, source by default). The token
budget of the root goes down level by level: each node's budget is shared among its
children by weight, no child gets more than its leaves can give (their tokens times
``max_epochs``), and what a child can't take goes to its siblings before the node as
a whole is short and hands the rest to its own siblings. A node takes part in a level
with what its whole subtree can give, so shortages are settled there first.

Budgets are whole tokens in exact arithmetic. Within a level the children are ordered
by capacity over weight; with b tokens and weight W left, the next one gets
min(capacity, b * weight div W), so that nothing is left over unless all are full.

A leaf whose budget is e epochs and a part takes all its documents e times and of the
next epoch the longest prefix, in that epoch's seeded order, whose tokens fit. The
order is the MD5 of seed, epoch and doc_id. The prefix's end is found by counting
tokens of 1,024 ranges of that hash, then of 1,024 ranges within the range where the
budget ends, and only within the last range row by row. So no task sees a whole leaf,
however large, and nothing but the tree is aggregated.

Nulls, empty and repeated rows: a null level is the node ``(null)``. A text without
words, or null, has no tokens; it follows its leaf's epochs and its place in the
order. A null doc_id is hashed as an empty one. Rows that repeat a doc_id share its
place and are taken or left together at the end of a prefix. An empty table gives no
rows. Other columns are kept, but for n_tokens and n_epochs of the input. Names
ending in ``_`` are reserved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.storage import stored

#: Ranges of the seeded order on each of two levels.
RANGES = 1024
WORD = r"[^\x20\x09-\x0D]+"
DEFAULT_WEIGHT = 1


def token_count() -> Column:
    """Words of ``text``."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def _weight(level: str, weights: dict[str, int]) -> Column:
    """Each child's weight: its own, or DEFAULT_WEIGHT. At most one literal for each weight named."""
    return reduce(lambda out, kv: out.when(F.col(level) == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0)).otherwise(DEFAULT_WEIGHT).cast("long")


def _shared(children: DataFrame, parent: list[str]) -> DataFrame:
    """``budget`` of each child from ``parent_budget``, its ``capacity`` and ``weight`` among its siblings.

    In order of capacity over weight, a child that gets less than its capacity leaves
    none but proportional shares to those after it, so the budgets follow from sums
    over the siblings before: no loop over children is needed.
    """
    # Capacity over weight, in thousandths of a token.
    order = [F.expr("(cast(capacity as decimal(38,0)) * 1000) div weight"), F.col("node_")]
    before = Window.partitionBy(*parent).orderBy("place_").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*parent).orderBy("place_").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = children.filter("weight > 0").withColumn("place_", F.row_number().over(Window.partitionBy(*parent).orderBy(*order)))
    sums = placed.withColumns({"given_": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "weight_left_": F.sum("weight").over(after)})
    # A child is full if all before it are and its share of what they leave reaches its capacity.
    fits = _whole("capacity") * _whole("weight_left_") <= (_whole("parent_budget") - _whole("given_")) * _whole("weight")
    full = sums.withColumn("full_", F.min(fits.cast("int")).over(Window.partitionBy(*parent).orderBy("place_")) == 1)
    rest = Window.partitionBy(*parent)
    open_ = full.withColumns({
        "rest_": _whole("parent_budget") - F.coalesce(F.sum(F.when(F.col("full_"), F.col("capacity"))).over(rest), F.lit(0)),
        "open_": F.coalesce(F.sum(F.when(~F.col("full_"), F.col("weight"))).over(rest), F.lit(0)),
        "run_": F.coalesce(F.sum(F.when(~F.col("full_"), F.col("weight"))).over(before), F.lit(0)),
    })
    # Shares as differences of rounded-down running sums: they add up to the rest.
    part = lambda w: F.expr(f"(rest_ * cast({w} as decimal(20,0))) div cast(open_ as decimal(20,0))")
    share = F.when(F.col("full_"), F.col("capacity")).otherwise(F.least(F.col("capacity"), part("(run_ + weight)") - part("run_")))
    return open_.withColumn("budget", share.cast("long")).drop("place_", "given_", "weight_left_", "full_", "rest_", "open_", "run_")


def budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """The columns ``levels`` with each leaf's ``budget``; ``leaves`` has levels and ``tokens``."""
    leaves = leaves.withColumn("root_", F.lit(0))
    now = leaves.groupBy("root_").agg(F.sum("tokens").alias("all_")).select("root_", F.expr(f"(cast(all_ as decimal(38,0)) * {percent}) div 100").alias("parent_budget"))
    above = ["root_"]
    for level, own in zip(levels, weights, strict=True):
        key = [*above, level]
        children = leaves.groupBy(*key).agg((F.sum("tokens") * max_epochs).cast("long").alias("capacity")).withColumns({"weight": _weight(level, own), "node_": F.col(level)})
        now = _shared(children.join(now, above), above).select(*key, F.col("budget").alias("parent_budget"))
        above = key
    return now.withColumnRenamed("parent_budget", "budget").drop("root_")


def seeded(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A place in [0, 2**40) for each document and epoch."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 10), 16, 10).cast("long")


def _range_end(rows: DataFrame, levels: list[str], at: Column) -> DataFrame:
    """For each leaf the range in which its ``left_`` tokens end, and what is left there."""
    ranges = rows.groupBy(*levels, at.alias("range_")).agg(F.sum("tokens_").alias("n_"), F.first("left_").alias("left_"))
    before = Window.partitionBy(*levels).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    run = ranges.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    # The first range that doesn't fit as a whole; ranges whose start is beyond the budget come after it.
    ends = run.filter("before_ + n_ > left_").groupBy(*levels).agg(F.min(F.struct("range_", "before_", "left_")).alias("end_"))
    return ends.select(*levels, F.col("end_.range_").alias("range_"), (F.col("end_.left_") - F.col("end_.before_")).alias("left_"))


def mixture(docs: DataFrame, levels: list[str], weights: list[dict[str, int]], percent: int = 100, max_epochs: int = 1, seed: int = 0, keep_text: bool = False) -> DataFrame:
    """All rows of docs that the mixture takes, with ``n_tokens`` and ``n_epochs``, how often each is taken; without ``text`` unless it is kept.

    ``weights`` has for each level the weights of named children, whole numbers;
    others weigh 1, and 0 leaves a child out. The budget is ``percent`` of all tokens.
    """
    tree = [f"level{i}_" for i in range(len(levels))]
    named = docs.drop("n_tokens", "n_epochs").withColumns({t: F.coalesce(F.col(c).cast("string"), F.lit("(null)")) for t, c in zip(tree, levels, strict=True)})
    counted = named.withColumn("tokens_", token_count())
    rows = stored(counted.drop("text"), "mixed")
    leaves = stored(rows.groupBy(*tree).agg(F.sum("tokens_").alias("tokens")), "leaves")
    shares = budgets(leaves, tree, weights, percent, max_epochs).join(leaves, tree)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    shares = stored(shares.select(*tree, whole.cast("int").alias("epochs_"), (F.col("budget") - whole * F.col("tokens")).cast("long").alias("left_")), "shares")
    high, low = F.expr(f"place_ div {1 << 30}"), F.expr(f"(place_ div {1 << 20}) % {RANGES}")
    part = rows.select(*tree, "doc_id", "tokens_").join(shares.filter("left_ > 0"), tree).withColumn("place_", seeded(F.col("doc_id"), F.col("epochs_"), seed))
    part = stored(part.select(*tree, "doc_id", "tokens_", "left_", "place_"), "places")
    first = stored(_range_end(part, tree, high), "ends")
    within = part.drop("left_").join(first.withColumnRenamed("range_", "high_"), tree).filter(high == F.col("high_"))
    second = stored(_range_end(within.drop("high_"), tree, low), "ends").withColumnRenamed("range_", "low_")
    last = within.drop("left_").join(second, tree).filter(low == F.col("low_"))
    run = F.sum("tokens_").over(Window.partitionBy(*tree).orderBy("place_", "doc_id"))  # rows that tie in both stand together
    over = last.withColumn("run_", run).filter("run_ > left_").groupBy(*tree).agg(F.min(F.struct("place_", "doc_id")).alias("stop_"))
    # A leaf without an end takes its part whole: its documents all fit.
    ends = stored(shares.join(over, tree, "left"), "ends")
    place = seeded(F.col("doc_id"), F.col("epochs_"), seed)
    taken = (F.col("left_") > 0) & (F.col("stop_").isNull() | (F.struct(place.alias("place_"), F.col("doc_id")) < F.col("stop_")))
    out = (counted if keep_text else rows).join(ends, tree).withColumn("n_epochs", F.col("epochs_") + taken.cast("int"))
    return out.filter("n_epochs > 0").withColumnRenamed("tokens_", "n_tokens").drop("epochs_", "left_", "stop_", *tree)
