"""Ranks and running sums of groups of any size: rows are sorted over ranges, and ranges get the totals of those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored


def _ordered(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Rows sorted by keys and order over ranges, with their place in their task; written, so that all readers see the same ranges."""
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__id", F.monotonically_increasing_id())
    return stored(rows, "ordered").withColumn("__part", F.shiftright("__id", 33))


def _with_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Joins what is known of each key's part of a range; null keys are keys."""
    ranges = ranges.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate([*keys, "__part"])})
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__part"])]
    return rows.join(ranges, same).drop(*[f"__k{i}" for i in range(len(keys) + 1)])


def _before(keys: list[str]) -> Window:
    """Ranges before one; there is a row for each key and range it reaches into."""
    return Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def global_rank(df: DataFrame, keys: list[str], order: list[Column | str], out: str, total: str | None = None) -> DataFrame:
    """Ranks (from 1) within keys by an order that should have no ties, and the number of the key's rows, if asked for.

    No task has more than its range of rows, however many a key has. Rows of equal keys and order stay in one range.
    """
    rows = _ordered(df, keys, order)
    ranges = rows.groupBy(*keys, "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    ranges = ranges.withColumn("__offset", F.coalesce(F.sum("__n").over(_before(keys)), F.lit(0)))
    if total:
        ranges = ranges.withColumn(total, F.sum("__n").over(Window.partitionBy(*keys)))
    ranked = _with_ranges(rows, ranges.drop("__n"), keys)
    return ranked.withColumn(out, F.col("__id") - F.col("__first") + F.col("__offset") + 1).drop("__id", "__part", "__first", "__offset")


def sum_before(df: DataFrame, keys: list[str], order: list[Column | str], value: str, out: str) -> DataFrame:
    """The sum of a key's values before each row; a key is shared out over ranges as in `global_rank`."""
    rows = _ordered(df, keys, order)
    ranges = rows.groupBy(*keys, "__part").agg(F.sum(value).alias("__sum")).withColumn("__offset", F.coalesce(F.sum("__sum").over(_before(keys)), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*keys, "__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    summed = _with_ranges(rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))), ranges, keys)
    return summed.withColumn(out, F.col("__offset") + F.col("__inside")).drop("__id", "__part", "__offset", "__inside")
