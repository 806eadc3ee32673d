"""Prefix sums over an ordered table without a task that sees all rows, and lookup in sorted ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import materialise


def running_sum(rows: DataFrame, order: str | tuple[str, ...], value: str, name: str = "before") -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows that come before by ``order`` (distinct values).

    Rows are dealt to ranges of ``order``; sums within a range come from a window, and the ranges' totals, one row each, are added
    up on the driver.
    """
    by = [F.col(c) for c in ((order,) if isinstance(order, str) else order)]
    dealt = materialise(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    starts, total = [], 0
    for part, amount in sorted((r[0], r[1]) for r in dealt.groupBy("__part").agg(F.sum(value)).collect()):
        starts.append((part, total))
        total += amount or 0
    base = rows.sparkSession.createDataFrame(starts or [(0, 0)], "__part int, __start long")
    inside = F.sum(value).over(W.partitionBy("__part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1))
    met = dealt.withColumn("__inside", inside).join(F.broadcast(base), "__part")
    return met.withColumn(name, F.col("__start") + F.coalesce("__inside", F.lit(0))).drop("__part", "__start", "__inside")


def running_sum_within(rows: DataFrame, group: str, order: str, value: str, name: str = "before") -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (not negative) over the rows of the same ``group`` that come before by ``order``.

    Ranges are of group and order together, so a large group is spread over tasks; what comes before a group is the least sum in it.
    """
    summed = running_sum(rows, (group, order), value, name)
    first = summed.groupBy(group).agg(F.min(name).alias("__first"))
    # as many groups as there may be mustn't be sent through the driver
    return summed.join(first.hint("merge"), group).withColumn(name, F.col(name) - F.col("__first")).drop("__first")


def dense_ids(rows: DataFrame, column: str) -> DataFrame:
    """(column, id): ids 0, 1, ... in the order of distinct values."""
    return running_sum(rows.select(column).withColumn("__one", F.lit(1).cast("long")), column, "__one", "id").select(column, "id")


def arg_max(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row (key, value): the key of the largest value, smallest key first."""
    return rows.orderBy(F.desc(value), key).select(key, value).limit(1)


def range_of(value: Column, starts: list[int]) -> Column:
    """The number, from 0, of the last of the sorted ``starts`` that isn't above ``value``; null below the first.

    The search is a tree of comparisons, as deep as the logarithm of the number of starts.
    """

    def search(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < starts[middle], search(low, middle)).otherwise(search(middle, high))

    return F.when(value >= starts[0], search(0, len(starts))).cast("long") if starts else F.lit(None).cast("long")
