"""Ranks, running sums and medians of groups that no single task should hold."""

from __future__ import annotations

import random
import statistics
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from duolume.operators import boxes, ranks
from duolume.operators.quantiles import aggregate_with_medians
from duolume.plans import store_queries
from duolume.sources.annotations import place_files


@pytest.fixture(scope="module", autouse=True)
def separate_ranges(spark):
    """Small ranges would be put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    """One group has nearly all rows; some keys are null; values repeat."""
    rng = random.Random(4)
    return spark.createDataFrame([(None if k % 50 == 7 else 0 if k % 10 else k % 70, rng.randint(0, 40), k, float(rng.choice([0, 0, 0, k, rng.random()]))) for k in range(6000)], "g long, v long, id long, x double").repartition(5).persist()


def test_ranks_equal_those_of_a_window(rows):
    w = Window.partitionBy("g")
    want = rows.withColumn("rank", F.row_number().over(w.orderBy("v", "id")).cast("long")).withColumn("n", F.count("*").over(w))
    got = ranks.global_rank(rows, ["g"], ["v", "id"], "rank", "n")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    down = ranks.global_rank(rows, [], [F.col("v").desc(), "id"], "rank").filter("rank <= 3").orderBy("rank").collect()
    assert [x["id"] for x in down] == [x["id"] for x in rows.orderBy(F.desc("v"), "id").limit(3).collect()]
    assert ranks.global_rank(rows.limit(0), ["g"], ["v", "id"], "rank").collect() == []


def test_a_group_of_all_rows_is_shared_out(spark, rows):
    one = rows.withColumn("g", F.lit(1))
    per = ranks._ordered(one, ["g"], ["v", "id"]).groupBy("__part").count().collect()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(per) == n and max(x["count"] for x in per) <= 2 * 6000 / n


def test_sums_before(rows):
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    got = ranks.sum_before(rows, ["g"], ["v", "id"], "v", "s")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_parts_of_equal_bytes(spark):
    rng = random.Random(1)
    files = spark.createDataFrame([(s, f"/{s}/{k:05}", rng.randint(1, 400)) for s in ("a", "b") for k in range(3000)], "split string, path string, length long")
    sizes = {}
    for x in place_files(files, 20_000).collect():
        sizes.setdefault(x["split"], {}).setdefault(x["part"], []).append(x["length"])
    for parts in sizes.values():
        assert sorted(parts) == list(range(len(parts))) and all(0.9 * 20_000 <= sum(v) <= 1.1 * 20_000 for k, v in parts.items() if k < len(parts) - 1)


@pytest.mark.parametrize("most", [10, 300, 100_000])
def test_medians_of_large_groups(rows, most):
    others = [F.count("*").alias("n")]
    got = {x["g"]: x for x in aggregate_with_medians(rows, ["g"], ["v", "x", "id"], others, most).collect()}
    have = {}
    for x in rows.collect():
        have.setdefault(x["g"], []).append(x)
    assert set(got) == set(have)
    for g, xs in have.items():
        assert got[g]["n"] == len(xs)
        for c in ("v", "x", "id"):
            assert got[g][f"{c}_median"] == statistics.median(x[c] for x in xs)


def test_medians_of_odd_values(spark):
    """Ties of nearly all rows, infinities, NaN (the largest), nulls, groups without values."""
    values = [0.0] * 500 + [float("inf")] * 300 + [float("-inf")] * 150 + [float("nan")] * 90 + [float(k) for k in range(1, 40)]
    df = spark.createDataFrame([(1, x) for x in values] + [(2, None)] * 3 + [(3, float(k)) for k in range(100)] + [(4, 5.0)] * 200, "g long, v double").repartition(4)
    got = {x["g"]: x["v_median"] for x in aggregate_with_medians(df, ["g"], ["v"], [F.count("*").alias("n")], 20).collect()}
    want = {x["g"]: x["m"] for x in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == want
    assert aggregate_with_medians(df.limit(0), ["g"], ["v"], [F.count("*").alias("n")], 20).collect() == []


def test_equivalent_options_of_one_large_group(spark):
    """Each option meets two of its group, not all: 40,000 options of one group are 1.6 billion pairs."""
    small = [(k, 9 - k % 10, k % 2, k % 3) for k in range(10)]
    options = spark.createDataFrame(small + [(k, k, 7, 7) for k in range(10, 40_010)], "option long, place long, version int, extension int")
    start = time.monotonic()
    got = {x["option"]: x["equivalent"] for x in boxes.equivalent_option(options, options.filter("option <> 3").select("option")).collect()}
    assert time.monotonic() - start < 40
    assert {k: v for k, v in got.items() if k >= 10} == {k: 11 if k == 10 else 10 for k in range(10, 40_010)}
    want = {a: min(((p, b) for b, p, v, e in small if b not in (a, 3) and (v, e) == (va, ea)), default=None) for a, _, va, ea in small}
    assert {k: v for k, v in got.items() if k < 10} == {k: x[1] for k, x in want.items() if x}


def test_no_task_writes_a_whole_folder_of_annotations(spark):
    path = store_queries._annotations(spark, "/root/testdata/sf0.001", [F.col(c) for c in "xywh"])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "/folder=([^/]+)/", 1).alias("folder"))
    assert all(x["count"] > 1 for x in files.groupBy("folder").count().collect())
