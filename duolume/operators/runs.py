"""Run analytics: catalogue, tables of results, percentiles, curves."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolume.functions.names import BASELINE, REGIMES

from .quantiles import aggregate_with_medians

#: 90th percentile of a normal distribution as the cell tables round it.
Z90_CELLS = 1.28
LAMR_FLOOR = 1e-10


def sample_std(value: Column) -> Column:
    """Sample deviation; 0 for a single value."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def build_cells(runs: DataFrame, reducer: str = "mean", z: float = Z90_CELLS) -> DataFrame:
    """method x equalization cells: n, mean, std, median, p90, best, and the chosen reducer as value."""
    others = [F.count("*").alias("n"), F.avg("value").alias("mean"), sample_std(F.col("value")).alias("std"), F.max("value").alias("best")]
    cells = aggregate_with_medians(runs.filter(F.col("value").isNotNull()), ["method", "equalization"], ["value"], others).withColumnRenamed("value_median", "median")
    cells = cells.withColumn("p90", F.col("mean") + F.lit(z) * F.col("std"))
    return cells.withColumn("value", F.col(reducer))


def pivot_cells(cells: DataFrame) -> DataFrame:
    """One row for each method, a column for each regime."""
    return cells.groupBy("method").pivot("equalization", list(REGIMES)).agg(F.first("value"))


def regime_means(cells: DataFrame) -> DataFrame:
    """Mean of each regime's cells over the methods that have one."""
    return cells.groupBy("equalization").agg(F.avg("value").alias("mean"), F.count("value").alias("methods"))


def delta_vs_baseline(cells: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Each cell against its method's baseline cell, with the noise pooled over cells of several runs."""
    noise = F.sqrt(F.avg(F.when(F.col("n") > 1, F.col("std") * F.col("std"))).over(Window.partitionBy("method")))
    base = F.max(F.when(F.col("equalization") == baseline, F.col("value"))).over(Window.partitionBy("method"))
    out = cells.withColumn("noise", noise).withColumn("base", base)
    return out.filter((F.col("equalization") != baseline) & F.col("base").isNotNull()).select("method", "equalization", "value", "base", (F.col("value") - F.col("base")).alias("delta"), "noise")


def keep_covered(runs: DataFrame, least: int) -> DataFrame:
    """Runs of methods seen under enough regimes."""
    seen = runs.groupBy("method").agg(F.count_distinct("equalization").alias("k")).filter(F.col("k") >= least)
    return runs.join(seen, "method", "left_semi")


def averaged_table(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric for each group."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), *[f(m).alias(f"{m}_{s}") for m in metrics for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def summarize(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, median, population deviation and count of each metric; nulls are skipped."""
    return aggregate_with_medians(df, keys, metrics, [f(m).alias(f"{m}_{s}") for m in metrics for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.count, "n"))])


def summarize_map(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean, population deviation and count of each entry of a map column."""
    return df.select(*keys, F.explode(column).alias("name", "weight")).groupBy(*keys, "name").agg(F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("std"), F.count("weight").alias("n"))


def mode_counts(df: DataFrame, keys: list[str], column: str, flag: str) -> DataFrame:
    """Share of a flag, the most frequent value (the smallest of equals), and how often it occurs."""
    rate = df.groupBy(*keys).agg(F.avg(F.col(flag).cast("double")).alias("rate"))
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("c"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), F.col(column).alias("v"))).alias("m"))
    return rate.join(best.select(*keys, F.col("m.v").alias("mode"), (-F.col("m.c")).alias("mode_n")), keys)


def normal_percentile(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """Percentile of a normal fit: 0 without values, the value itself if it is alone, else mean + z std."""
    z = NormalDist().inv_cdf(p / 100)
    n, mean, std = F.count(value), F.avg(value), F.stddev_samp(value)
    fit = F.when(n == 0, F.lit(0.0)).when((n == 1) | std.isNull() | (std == 0), mean).otherwise(mean + F.lit(z) * std)
    return df.groupBy(*keys).agg(n.alias("n"), fit.alias("percentile"))


def curve_envelope(curves: DataFrame, keys: list[str], duration: str | None = None) -> DataFrame:
    """Mean, least, most and count of a curve's points, and the mean duration of their runs, if there is such a column; NaN counts as missing."""
    value = F.nanvl("value", F.lit(None).cast("double"))
    return curves.groupBy(*keys, "pt").agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"), *([F.avg(F.nanvl(duration, F.lit(None).cast("double"))).alias("mean_duration")] if duration else []))


def metric_density(runs: DataFrame, keys: list[str], value: str, bins: int = 9) -> DataFrame:
    """Histogram density between least and most of each group, with its mean and population deviation; the last bin includes its upper edge."""
    rows = runs.filter(F.col(value).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("__n"))
    rows = rows.join(ends.withColumnsRenamed({k: f"__{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    rows = rows.withColumn("bin", F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1))))
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("low", "high", "mean", "std", "__n")])
    return counts.withColumn("density", F.col("n") / F.col("__n") / ((F.col("high") - F.col("low")) / bins)).drop("__n")


def normal_curve(runs: DataFrame, keys: list[str], value: str, points: int = 200, spread: float = 4.0) -> DataFrame:
    """The normal density of each group's mean and population deviation at evenly spaced points within 4 deviations, and how many whole deviations from the mean each is (mark: null between them). Groups without spread have none."""
    fit = runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).filter("std > 0")
    grid = fit.select(*keys, "mean", "std", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("pt")).withColumn("z", F.lit(-spread) + F.col("pt") * F.lit(2 * spread / points))
    near = F.round("z")
    return grid.select(*keys, F.col("pt").cast("long").alias("pt"), (F.col("mean") + F.col("z") * F.col("std")).alias("x"), (F.exp(-F.col("z") * F.col("z") / 2) / (F.col("std") * F.sqrt(F.lit(2 * math.pi)))).alias("density"), F.when(F.abs(F.col("z") - near) < 1e-9, near.cast("int")).alias("mark"))


def lamr(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Log-average miss rate: nine reference points from 0.01 to 1, linear between points.

    Left of a curve the miss rate is 1, right of it 0; values are floored before the logarithm.
    """
    w = Window.partitionBy(*keys).orderBy("fppi", "mr")
    segments = curves.withColumn("next_fppi", F.lead("fppi").over(w)).withColumn("next_mr", F.lead("mr").over(w))
    ends = curves.groupBy(*keys).agg(F.min("fppi").alias("first"), F.max("fppi").alias("last"), F.max_by("mr", F.struct("fppi", "mr")).alias("last_mr"))
    refs = [10 ** (-2 + i * 0.25) for i in range(9)]
    points = ends.select(*keys, "first", "last", "last_mr", F.explode(F.array(*[F.lit(x) for x in refs])).alias("ref"))
    inside = points.join(segments, keys).filter((F.col("ref") >= F.col("fppi")) & (F.col("ref") < F.col("next_fppi")))
    inside = inside.select(*keys, "ref", (F.col("mr") + (F.col("next_mr") - F.col("mr")) * (F.col("ref") - F.col("fppi")) / (F.col("next_fppi") - F.col("fppi"))).alias("at"))
    got = points.join(inside, [*keys, "ref"], "left")
    value = F.coalesce("at", F.when(F.col("ref") < F.col("first"), F.lit(1.0)).when(F.col("ref") == F.col("last"), F.col("last_mr")).otherwise(F.lit(0.0)))
    return got.groupBy(*keys).agg(F.exp(F.avg(F.log(F.greatest(value, F.lit(LAMR_FLOOR))))).alias("lamr"))


def lamr_step(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Log-average miss rate with the last miss rate at or below each reference point (1 before the curve)."""
    refs = F.explode(F.array(*[F.lit(10 ** (-2 + i * 0.25)) for i in range(9)]))
    got = curves.select(*keys, "fppi", "mr", refs.alias("ref")).groupBy(*keys, "ref").agg(F.max_by(F.when(F.col("fppi") <= F.col("ref"), F.col("mr")), F.when(F.col("fppi") <= F.col("ref"), F.struct("fppi", "mr"))).alias("at"))
    return got.groupBy(*keys).agg(F.exp(F.avg(F.log(F.greatest(F.coalesce("at", F.lit(1.0)), F.lit(LAMR_FLOOR))))).alias("lamr"))


def best_trials(runs: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """The best run of each group; the first key wins ties."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc_nulls_last(), key)
    return runs.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def top_k(df: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dedup_first(images: DataFrame, name: str, path: str) -> DataFrame:
    """The first path of each name, and how many there were."""
    return images.groupBy(name).agg(F.min(path).alias(path), F.count("*").alias("n"))


def boundaries(df: DataFrame, order: list[str], group: str) -> DataFrame:
    """Rows that start a new group in an ordered list. The list is a report, not a table."""
    w = Window.orderBy(*order)
    return df.withColumn("starts", F.coalesce(F.lag(group).over(w) != F.col(group), F.lit(True)))


def order_labels(df: DataFrame, label: str, group: str, value: str, groups: list[str], invert: bool = False) -> DataFrame:
    """Labels by their best value over groups, with a column for each group."""
    best = (F.min if invert else F.max)(value)
    wide = df.groupBy(label).pivot(group, groups).agg(best)
    edge = (F.least if invert else F.greatest)(*groups) if len(groups) > 1 else F.col(groups[0])
    return wide.withColumn("best", edge)


def common_tags(df: DataFrame, dataset: str, condition: str, selection: str) -> DataFrame:
    """Dataset and condition that all runs of a selection share, else null; and whether any differ."""
    out = df.groupBy(selection).agg(*[f(c).alias(f"{s}_{c}") for c in (dataset, condition) for f, s in ((F.min, "low"), (F.max, "high"))])
    same = {c: F.col(f"low_{c}") == F.col(f"high_{c}") for c in (dataset, condition)}
    return out.select(selection, *[F.when(same[c], F.col(f"low_{c}")).alias(c) for c in same], (~F.coalesce(same[dataset], F.lit(True)) | ~F.coalesce(same[condition], F.lit(True))).alias("is_mixed"))


def timing_table(df: DataFrame, method: str, ms: str) -> DataFrame:
    others = [F.avg(ms).alias("mean_ms"), F.stddev_samp(ms).alias("std_ms"), F.count(ms).alias("n")]
    return aggregate_with_medians(df, [method], [ms], others).withColumnRenamed(f"{ms}_median", "median_ms").orderBy("mean_ms", method)


def coverage_matrix(runs: DataFrame, rows: list[str], column: str, values: list[str], least: int = 5) -> DataFrame:
    """Counts of runs by setting, a column for each value, and whether any is below the least count."""
    wide = runs.groupBy(*rows).pivot(column, values).count().fillna(0, values)
    return wide.withColumn("incomplete", F.least(*[F.col(f"`{v}`") for v in values]) < least if len(values) > 1 else F.col(f"`{values[0]}`") < least)


#: Kinds of validations of a run, the more trusted first; then those on the other dataset.
IN_DOMAIN, CROSS = ("npzfix", "train", "val"), ("cross_kaist", "cross_llvip")
CELL = ["model_dataset", "equalization", "test_dataset", "condition"]
#: Methods that a matrix has columns for.
MOST_METHODS = 1_000


def coverage_cells(runs: DataFrame) -> DataFrame:
    """Runs of each setting and method: on the model's own dataset the count of the first kind (by priority) that has any, else the sum of both cross kinds."""
    wide = runs.groupBy(*CELL, "fusion").pivot("tag", [*IN_DOMAIN, *CROSS]).count()
    is_cross = ~F.col("test_dataset").startswith(F.col("model_dataset"))
    first = F.coalesce(*[F.nullif(F.col(x), F.lit(0)) for x in IN_DOMAIN], F.lit(0))
    both = sum((F.coalesce(x, F.lit(0)) for x in CROSS), F.lit(0))
    return wide.select(*CELL, "fusion", F.when(is_cross, "cross").otherwise("in_domain").alias("kind"), F.when(is_cross, both).otherwise(first).cast("long").alias("count"))


def coverage_table(runs: DataFrame) -> tuple[DataFrame, list[str]]:
    """A row for each setting, a column for each method of any setting (0 where it has no runs), and the methods."""
    cells = coverage_cells(runs)
    methods = [x[0] for x in cells.select("fusion").distinct().orderBy("fusion").limit(MOST_METHODS + 1).collect()]
    if len(methods) > MOST_METHODS:
        raise ValueError(f"over {MOST_METHODS} methods")
    return cells.groupBy(*CELL, "kind").pivot("fusion", methods).agg(F.first("count")).fillna(0, methods), methods


def coverage_long(runs: DataFrame, least: int = 5) -> DataFrame:
    """The same as rows, with those of fewer runs than wanted (but some) marked."""
    wide, methods = coverage_table(runs)
    return wide.unpivot([*CELL, "kind"], methods, "fusion", "count").withColumn("few", (F.col("count") > 0) & (F.col("count") < least))


def overlay_validation(runs: DataFrame, overrides: DataFrame, key: str, blocks: str) -> DataFrame:
    """Replaces result blocks by those of an override that has both kinds; flags the rows."""
    other = overrides.select(key, F.col(blocks).alias("new"))
    joined = runs.join(other, key, "left")
    names = F.map_keys("new")
    both = F.coalesce(F.exists(names, lambda x: x.startswith("pr_data_")) & F.exists(names, lambda x: x.startswith("validation_")), F.lit(False))
    kept = F.map_filter(blocks, lambda k, _: ~(k.startswith("pr_data_") | k.startswith("validation_")))
    return joined.withColumn("overridden", both).withColumn(blocks, F.when(both, F.map_concat(kept, "new")).otherwise(F.col(blocks))).drop("new")


def resolve_best(results: DataFrame, blocks: str = "blocks") -> DataFrame:
    """The blocks of the last epochs, or of the best epoch if either is missing; runs without both are dropped."""
    last = [F.concat(F.lit("pr_data_"), F.col("pr_epoch") - 1), F.concat(F.lit("validation_"), F.col("val_epoch") - 1)]
    best = [F.concat(F.lit(x), F.col("epoch_best_fit_index")) for x in ("pr_data_", "validation_")]
    has = lambda pair: F.map_contains_key(blocks, pair[0]) & F.map_contains_key(blocks, pair[1])
    pick = lambda i: F.when(has(last), F.element_at(blocks, last[i])).when(has(best), F.element_at(blocks, best[i]))
    return results.withColumn("pr_best", pick(0)).withColumn("validation_best", pick(1)).filter(F.coalesce(has(last), F.lit(False)) | F.coalesce(has(best), F.lit(False)))


def miss_rate(runs: DataFrame) -> DataFrame:
    """mr, mr_plot and fppi at the point of the best F1, from recall and FPPI arrays."""
    return runs.withColumns({"mr": F.transform("r", lambda x: 1 - x), "mr_plot": F.transform("r_plot", lambda x: 1 - x), "fppi": F.get("fppi_plot", F.col("max_f1_index"))})


def run_table(runs: DataFrame, metrics: str = "metrics") -> DataFrame:
    """One row for each run and class; classes named `all` are left out."""
    long = runs.select(*[c for c in runs.columns if c != metrics], F.explode(metrics).alias("class", "m")).filter(~F.col("class").contains("all"))
    return long.select("*", "m.*").drop("m")
