"""Seeded samples and splits. Order is a hash of the id, so results repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import global_rank

#: Hex digits of the hash that part a bucket: 65,536 parts, so that at 10^11 rows a task ranks some millions.
DIGITS = 4


def hash_order(key: str, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))


def quotas(counts: DataFrame, bucket: str, n: int) -> DataFrame:
    """Exact quota of each bucket by largest remainder, capped by its size; what is left goes to buckets in order. One row for each bucket."""
    every, order = Window.partitionBy(), Window.orderBy(bucket)
    total = F.sum("rows").over(every)
    want = F.least(F.lit(n), total)
    c = counts.withColumn("ideal", F.col("rows") * want / total).withColumn("want", want)
    c = c.withColumn("base", F.floor("ideal")).withColumn("rest", F.col("want") - F.sum(F.floor("ideal")).over(every))
    c = c.withColumn("place", F.row_number().over(Window.orderBy((F.col("ideal") - F.col("base")).desc(), bucket)))
    c = c.withColumn("quota", F.least(F.col("rows"), F.col("base") + (F.col("place") <= F.col("rest")).cast("long")))
    free = F.col("rows") - F.col("quota")
    c = c.withColumn("short", F.col("want") - F.sum("quota").over(every)).withColumn("free_before", F.coalesce(F.sum(free).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return c.select(bucket, (F.col("quota") + F.greatest(F.lit(0), F.least(free, F.col("short") - F.col("free_before")))).alias("quota"))


def stratified_sample(df: DataFrame, bucket: str, key: str, n: int, seed: str) -> DataFrame:
    """A sample of exactly n rows (or all), with buckets in proportion.

    Ranks come in two steps, so no bucket is sorted by one task: rows are ranked within
    parts of the hash range, and the parts before are counted.
    """
    rows = df.withColumn("__h", hash_order(key, seed)).withColumn("__p", F.conv(F.substring("__h", 1, DIGITS), 16, 10).cast("int"))
    counts = rows.groupBy(bucket, "__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(bucket).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    q = quotas(counts.groupBy(bucket).agg(F.sum("__n").alias("rows")), bucket, n)
    need = before.join(q, bucket).filter(F.col("__before") < F.col("quota"))
    kept = rows.join(need, [bucket, "__p"])
    rank = F.row_number().over(Window.partitionBy(bucket, "__p").orderBy("__h", key)) + F.col("__before")
    return kept.withColumn("__r", rank).filter(F.col("__r") <= F.col("quota")).select(*df.columns)


def split_calibration(df: DataFrame, key: str, seed: str, count: int | None = None, ratio: float | None = None) -> DataFrame:
    """Disjoint calibration and evaluation rows: a count, or a rounded share of at least one; never all of several rows."""
    n = df.count()
    k = min(max(0, count), n) if count is not None else max(1, round(n * (ratio or 0.0)))
    k = n - 1 if n > 1 and k >= n else k
    cut = stratified_sample(df.select(key).withColumn("__one", F.lit(1)), "__one", key, k, seed).select(key) if k else df.select(key).limit(0)
    return df.join(cut.withColumn("__cal", F.lit(True)), key, "left").withColumn("part", F.when(F.col("__cal"), F.lit("calibration")).otherwise("evaluation")).drop("__cal")


def cap(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def subsample(df: DataFrame, order: list[str], ratio: float) -> DataFrame:
    """The first rows of an order: a share of all, rounded down, but one row at least."""
    ranked = global_rank(df, [], order, "__rank", "__rows")
    return ranked.filter(F.col("__rank") <= F.greatest(F.lit(1), F.floor(F.col("__rows") * F.lit(ratio)))).drop("__rank", "__rows")


def top_shift(df: DataFrame, value: str, tie: str, n: int = 10) -> DataFrame:
    """The largest changes, whichever way."""
    return df.orderBy(F.abs(F.col(value)).desc(), tie).limit(n)


def incremental(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of which the key isn't stored yet: only these are computed again."""
    name = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256)
    return new.withColumn("cache_key", name).join(stored.withColumn("cache_key", name).select("cache_key"), "cache_key", "left_anti")
