"""Numbers in order without a window over a whole group.

Rows are dealt to tasks by ranges of (group, order) and sorted there, so a
group of any size spreads over as many tasks as it needs. A row's number is its
place among its group's rows of its task, after the rows of the group in
earlier tasks; those are summed in levels of ``FAN`` tasks each, so that no
task adds up more than ``FAN`` rows of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import stored

FAN = 256
_ROW_BITS = 33  # of monotonically_increasing_id


def in_ranges(df: DataFrame, order: list[Column], what: str = "ordered") -> DataFrame:
    """``df`` sorted into tasks by ``order`` and stored with ``_part``, the task's number, and ``_place`` in it."""
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stored(at.withColumns({"_part": F.shiftright("_at", _ROW_BITS), "_place": F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("_at"), what)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Both sides agree in ``keys``, nulls included."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])


def joined_to(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A null-safe join that keeps the left side's keys; neither side is broadcast."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(Column.__and__, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])
    return left.join(right.hint("merge"), on, how).drop(*[f"_r_{k}" for k in keys])


def before(counts: DataFrame, groups: list[str], part: str = "part", n: str = "n", fan: int = FAN) -> DataFrame:
    """``counts`` (groups, part, n) with ``before``: the sum of n over the group's smaller parts."""
    last = counts.agg(F.max(part)).first()[0]
    block = F.floor(F.col(part) / fan).cast("long")
    ahead = F.sum(n).over(Window.partitionBy(*groups, "_block").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    at = counts.withColumn("_block", block).withColumn("before", F.coalesce(ahead, F.lit(0)))
    if last is None or last < fan:
        return at.drop("_block")
    blocks = stored(at.groupBy(*groups, F.col("_block").alias(part)).agg(F.sum(n).alias(n)), "blocks")
    blocks = before(blocks, groups, part, n, fan).select(*groups, F.col(part).alias("_block"), F.col("before").alias("_ahead"))
    return joined_to(at, blocks, [*groups, "_block"]).withColumn("before", F.col("before") + F.col("_ahead")).drop("_block", "_ahead")


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str, fan: int = FAN) -> DataFrame:
    """``df`` with ``name``: each row's number in its group by ``order``, from 0.

    Ties must be broken by ``order``, or rows that tie are numbered in any
    order. Nulls are a group.
    """
    rows = in_ranges(df, [*[F.col(g).asc_nulls_first() for g in groups], *order])
    counts = stored(rows.groupBy(*groups, "_part").agg(F.count("*").alias("n"), F.min("_place").alias("_first")), "counts")
    starts = before(counts, groups, "_part", fan=fan).select(*groups, "_part", (F.col("before") - F.col("_first")).alias("_shift"))
    return joined_to(rows, starts, [*groups, "_part"]).withColumn(name, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")
