"""Exact medians of groups of any size, for many groups and columns at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

#: Values of a group that are ordered in one place; larger groups are narrowed down first.
MOST_ORDERED = 1_000_000
#: Cells of equal depth that a pass parts a group into, and the accuracy of the sketch that finds their bounds.
CELLS, ACCURACY = 256, 10_000
#: Large groups that are broadcast beside the rows; with more, rows are shuffled to them.
MOST_BROADCAST = 100_000


def aggregate_with_medians(df: DataFrame, keys: list[str], columns: list[str], others: list[Column], most_ordered: int = MOST_ORDERED) -> DataFrame:
    """keys, the other aggregates, and `<column>_median` of each numeric column, as F.median has it, without a buffer that grows with a group.

    Counts come first. Where all groups have few values, this is one aggregate. Else
    groups with few are ordered in a buffer, and in the others the middle values are
    searched (`large_medians`).
    """
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns]))
    large = stored(counts.select(*keys, each.alias("m")).select(*keys, "m.*").filter(F.col("n") > most_ordered), "large-groups")
    n_large = large.count()
    if not n_large:
        return df.groupBy(*keys).agg(*others, *[F.median(c).alias(f"{c}_median") for c in columns])
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(*keys, values.alias("m")).select(*keys, "m.*").filter("v is not null")
    group, beside = [*keys, "column"], F.broadcast if n_large <= MOST_BROADCAST else lambda x: x
    few = long.join(beside(_renamed(large, group)), _same(group), "left_anti").groupBy(*group).agg(F.median("v").alias("median"))
    medians = few.unionByName(large_medians(long, large, group, beside, most_ordered))
    wide = medians.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"{c}_median") for c in columns])
    return df.groupBy(*keys).agg(*others).join(_renamed(wide, keys), _same(keys), "left").drop(*[f"__{k}" for k in keys])


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__{k}" for k in keys})


def large_medians(long: DataFrame, large: DataFrame, group: list[str], beside, most_ordered: int) -> DataFrame:
    """group, median of the groups in `large` (group, n) of a table (group, v).

    For each of the two middle ranks a range of values is kept, open at both ends. A
    pass takes bounds of cells of equal depth from a sketch of fixed size, another
    counts exactly what lies below, at, between and above the two bounds around the
    rank. Either the value is hit, or the range shrinks to about 3 / CELLS of its
    rows, and loses at least those at its bounds. Ranges of few rows are ordered.
    No row is shuffled; each pass reads the table again.
    """
    k = F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)))
    none = F.lit(None).cast("double")
    state = large.select(*group, k.alias("k"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("base"), F.col("n").cast("long").alias("inside"), none.alias("value")).distinct()
    state = stored(state, "ranges")
    names = [*group, "k"]

    def rows_of(ranges: DataFrame) -> DataFrame:
        within = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
        return long.join(beside(_renamed(ranges, group)), _same(group)).filter(within).drop(*[f"__{g}" for g in group])

    while True:
        wide = state.filter((F.col("value").isNull()) & (F.col("inside") > most_ordered))
        if wide.isEmpty():
            break
        cells = rows_of(wide).groupBy(*names).agg(F.percentile_approx("v", [i / CELLS for i in range(CELLS + 1)], ACCURACY).alias("bounds"))
        place = F.floor((F.col("k") - F.col("base")) / F.col("inside") * CELLS).cast("int")
        at = lambda i: F.get("bounds", F.greatest(F.lit(0), F.least(F.lit(CELLS), place + i)))
        joined = wide.join(_renamed(cells, names), _same(names)).drop(*[f"__{x}" for x in names])
        wide = stored(joined.withColumn("a", at(-1)).withColumn("b", at(2)).drop("bounds"), "bounds")
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        parts = {"c0": v < a, "c1": v == a, "c2": (v > a) & (v < b), "c3": (v == b) & (a < b), "c4": v > b}
        sums = rows_of(wide).groupBy(*names).agg(*[F.count(F.when(x, 1)).alias(c) for c, x in parts.items()])
        joined = wide.join(_renamed(sums, names), _same(names)).drop(*[f"__{x}" for x in names])
        rank, upto = F.col("k") - F.col("base"), lambda n: sum((F.col(f"c{i}") for i in range(1, n)), F.col("c0"))
        pick = lambda *x: F.when(rank < upto(1), x[0]).when(rank < upto(2), x[1]).when(rank < upto(3), x[2]).when(rank < upto(4), x[3]).otherwise(x[4])
        nothing = F.lit(0).cast("long")
        narrow = joined.select(
            *names, pick(F.col("low"), none, a, none, b).alias("low"), pick(a, none, b, none, F.col("high")).alias("high"),
            (F.col("base") + pick(nothing, nothing, upto(2), nothing, upto(4))).alias("base"), pick(F.col("c0"), nothing, F.col("c2"), nothing, F.col("c4")).alias("inside"),
            pick(none, a, none, b, none).alias("value"),
        )
        kept = state.filter(F.col("value").isNotNull() | (F.col("inside") <= most_ordered))
        state = stored(kept.unionByName(narrow), "ranges")
    ordered = rows_of(state.filter("value is null")).groupBy(*names).agg(F.array_sort(F.collect_list("v")).alias("vs"), F.first("base").alias("base"))
    found = ordered.select(*names, F.get("vs", (F.col("k") - F.col("base")).cast("int")).alias("value"))
    return state.filter("value is not null").select(*names, "value").unionByName(found).groupBy(*group).agg(F.avg("value").alias("median"))
