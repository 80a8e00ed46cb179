"""Small joins and tables around methods, settings and scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolume.functions.names import eq_from_text, eq_regime, method_rank

from .neighbours import against_all
from .quantiles import aggregate_with_medians
from .ranks import global_rank


def method_metadata(methods: DataFrame, registry: DataFrame) -> DataFrame:
    """Version, symbol and module of each method; identities and unknown methods have defaults."""
    m = F.coalesce(F.col("method"), F.lit(""))
    identity = m.isin("visible", "lwir")
    name = F.when(m == "", F.lit("unknown_option")).otherwise(m)
    known = F.col("registered").isNotNull()
    out = methods.join(registry.select(F.col("method").alias("registered"), F.col("version").alias("v"), F.col("symbol").alias("s"), F.col("module").alias("mo")), F.col("method") == F.col("registered"), "left")
    return out.select(*methods.columns, F.when(known, F.coalesce("v", F.lit("unknown"))).when(identity, F.lit("builtin_identity_v1")).otherwise("unknown").alias("version"), F.when(known, F.coalesce("s", m)).otherwise(name).alias("symbol"), F.when(known, F.coalesce("mo", F.lit("unknown_module"))).when(identity, F.lit("builtin")).otherwise("unknown_module").alias("module"))


def merge_redundancy(df: DataFrame, overview: DataFrame) -> DataFrame:
    """Each row with its method's redundancy; a method without one is an error when the rows are read."""
    joined = df.join(overview.select("method", F.col("redundancy").alias("__r")), "method", "left")
    value = F.when(F.col("__r").isNull(), F.raise_error(F.concat(F.lit("no redundancy for "), F.col("method"))).cast("double")).otherwise(F.col("__r"))
    return joined.withColumn("redundancy", value).drop("__r")


def eq_mismatches(runs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Runs whose folder names another regime than their options, their results, or hints in the text say (in that order)."""
    j = runs.join(results, key, "left")
    have = lambda a, b: F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), eq_regime(F.col(a), F.col(b)))
    j = j.withColumn("expected", F.coalesce(have("rgb_eq", "thermal_eq"), have("result_rgb_eq", "result_thermal_eq"), eq_from_text(F.col("hint"))))
    return j.filter(F.col("expected").isNotNull() & (F.col("expected") != F.col("folder_regime"))).select(key, "folder_regime", "expected")


def trials_of(groups: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of each selected group: the key without its last segment."""
    return runs.withColumn("group_key", F.regexp_replace("run_key", "/[^/]*$", "")).join(groups, "group_key")


#: Rows of which an anchor's distances are ranked in one task.
MOST_RANKED = 4_000_000


def distance_preservation(vectors: DataFrame, id_col: str, full: str, part: str, anchors: Column) -> DataFrame:
    """Rank correlation of distances to stated anchors in two representations; ordinal ranks, over all rows and each anchor.

    An anchor's distances (16 bytes a row) are made and ranked in one task, which reads the rows as a stream; beyond
    MOST_RANKED of them all pairs are ranked over ranges.
    """
    copies = vectors.filter(anchors).groupBy(id_col).count().agg(F.max("count")).first()[0] or 0
    if vectors.count() * copies > MOST_RANKED:
        return _preservation_over_ranges(vectors, id_col, full, part, anchors)

    def correlate(anchor, ids, df, dp):
        other, ranks = ids != anchor, []
        for d in (df[other], dp[other]):
            r = np.empty(len(d))
            r[np.argsort(d, kind="stable")] = np.arange(len(d)) - (len(d) - 1) / 2  # rows are in the order of ids
            ranks.append(r)
        a, b = ranks
        found = [float((a * b).sum() / (a * a).sum())] if len(a) > 1 else [None][: len(a)]
        return pa.array([anchor] * len(found), pa.int64()), pa.array(found, pa.float64())

    return against_all(vectors, anchors, id_col, [full, part], correlate, "anchor long, spearman double")


def _preservation_over_ranges(vectors: DataFrame, id_col: str, full: str, part: str, anchors: Column) -> DataFrame:
    a = vectors.filter(anchors).select(F.col(id_col).alias("anchor"), F.col(full).alias("af"), F.col(part).alias("ap"))
    square = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    pairs = vectors.crossJoin(a).filter(F.col(id_col) != F.col("anchor")).select("anchor", F.col(id_col).alias("id"), square(F.col(full), F.col("af")).alias("df"), square(F.col(part), F.col("ap")).alias("dp"))
    ranked = global_rank(global_rank(pairs, ["anchor"], ["df", "id"], "rf"), ["anchor"], ["dp", "id"], "rp")
    return ranked.groupBy("anchor").agg(F.corr("rf", "rp").alias("spearman"))


#: Values of a metric that are listed in a row.
MOST_LISTED = 100_000


def method_metrics(df: DataFrame, where: Column, metrics: list[str]) -> DataFrame:
    """Sorted values (null for methods with over MOST_LISTED runs), mean, population deviation and median of each metric of a slice's methods."""
    rows = df.filter(where)
    few = rows.groupBy("method").agg(F.count("*").alias("__n")).filter(F.col("__n") <= MOST_LISTED)
    listed = rows.join(few, "method", "left_semi").groupBy("method").agg(*[F.array_sort(F.collect_list(m)).alias(f"{m}_values") for m in metrics])
    others = [F.count("*").alias("n_runs"), *[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]]
    return aggregate_with_medians(rows, ["method"], metrics, others).join(listed, "method", "left")


def detection_per_method(df: DataFrame, value: str, z: float = 1.28) -> DataFrame:
    """Mean, sample deviation, median and 90th percentile of each method."""
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    others = [F.avg(value).alias("mean"), std.alias("std"), (F.avg(value) + F.lit(z) * std).alias("p90")]
    return aggregate_with_medians(df, ["method"], [value], others).withColumnRenamed(f"{value}_median", "median")


def metric_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Variation in percent, mean, deviation and count by condition and channel."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, 100 * F.col("std") / F.col("mean")).otherwise(F.lit(0.0)))


def order_methods(df: DataFrame, value: str | None = None) -> DataFrame:
    """In the fixed order of families, or by a baseline value."""
    return df.orderBy(F.col(value).desc(), "method") if value else df.orderBy(method_rank(F.col("method")), "method")


def concat_slices(slices: list[DataFrame], anchors: tuple[str, ...] = ("visible", "lwir")) -> tuple[DataFrame, DataFrame]:
    """Slices below each other: methods, and the anchors apart."""
    out = slices[0]
    for s in slices[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    is_anchor = F.col("method").isin(*anchors)
    return out.filter(~is_anchor), out.filter(is_anchor)


def name_sets(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """All names of two tables, and in which they are."""
    both = a.select(column, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(column, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    return both.groupBy(column).agg((F.max("in_a") == 1).alias("in_a"), (F.max("in_b") == 1).alias("in_b"))


def sigma_shape(sigmas: DataFrame, keys: list[str]) -> DataFrame:
    """Least and largest deviation over alpha, where they are, and their ratio."""
    return sigmas.groupBy(*keys).agg(F.min("sigma").alias("low"), F.max("sigma").alias("high"), F.min_by("alpha", F.struct("sigma", "alpha")).alias("alpha_low"), F.max_by("alpha", F.struct("sigma", "alpha")).alias("alpha_high"), F.when(F.min("sigma") > 0, F.max("sigma") / F.min("sigma")).alias("ratio"))


def recalibrate_means(summary: DataFrame, knots: Column, column: str, out: str) -> DataFrame:
    """A calibrated mean from a summary's mean."""
    from .stats import interp_column

    return summary.withColumn(out, 1 - interp_column(knots, F.col(column)))


def with_calibration(df: DataFrame, calibrated: DataFrame, keys: list[str]) -> DataFrame:
    """Calibrated fields where there are any, else null."""
    return df.join(calibrated, keys, "left")


def reg_crosscheck(scored: DataFrame) -> DataFrame:
    """Thermal share by regression next to the latent shares."""
    return scored.select("method", "image_id", (1 - F.col("reg") / 100).alias("reg_share"), "latent_z", "latent_z_alpha_dep", (F.col("latent_z") - (1 - F.col("reg") / 100)).alias("difference"))


