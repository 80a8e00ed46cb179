"""Small tables around methods over parts, events, documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolume.operators import tables as T

from .name_queries import NAMED, named
from .run_queries import rounded
from .score_queries import SAMPLES, events_as_samples
from .views import PART_RUNS, RUNS, part_runs, runs, table


def b25(spark, d):
    registry = spark.createDataFrame([("rgbt_v2", "v1", "combine_rgbt_v2", "static"), ("pca", "v3", None, "pca_fa"), ("ssim", None, "combine_ssim", None)], "method string, version string, symbol string, module string")
    return T.method_metadata(named(spark, d).select("p_partkey", "method"), registry).drop("method")


B25 = f"""WITH {NAMED}, g(method, v, s, m) AS (VALUES ('rgbt_v2', 'v1', 'combine_rgbt_v2', 'static'), ('pca', 'v3', NULL, 'pca_fa'), ('ssim', NULL, 'combine_ssim', NULL))
SELECT p_partkey, CASE WHEN g.method IS NOT NULL THEN coalesce(v, 'unknown') WHEN n.method IN ('visible', 'lwir') THEN 'builtin_identity_v1' ELSE 'unknown' END AS version, coalesce(s, n.method) AS symbol,
  CASE WHEN g.method IS NOT NULL THEN coalesce(m, 'unknown_module') WHEN n.method IN ('visible', 'lwir') THEN 'builtin' ELSE 'unknown_module' END AS module FROM named n LEFT JOIN g USING (method)"""


def c5(spark, d):
    r = runs(spark, d)
    overview = r.groupBy("method").agg((F.count("*") / 10000).alias("redundancy"))
    return T.merge_redundancy(r.select("run_id", "method"), overview)


def c11(spark, d):
    n = named(spark, d)
    opts = n.select("p_partkey", F.col("regime").alias("folder_regime"), F.when(F.col("p_partkey") % 3 == 0, F.col("thermal")).alias("thermal_eq"), F.when(F.col("p_partkey") % 3 == 0, F.lit("none")).alias("rgb_eq"))
    res = n.filter("p_partkey % 3 = 1").select("p_partkey", F.lit("clahe").alias("result_rgb_eq"), F.lit("none").alias("result_thermal_eq"), F.lit(None).cast("string").alias("hint")).unionByName(n.filter("p_partkey % 3 = 2").select("p_partkey", F.lit(None).cast("string").alias("result_rgb_eq"), F.lit(None).cast("string").alias("result_thermal_eq"), F.lit("x/th_equalization/y").alias("hint")))
    return T.eq_mismatches(opts, res, "p_partkey")


C11 = f"""WITH {NAMED}, e AS (SELECT p_partkey, regime AS folder_regime, CASE p_partkey % 3 WHEN 0 THEN CASE thermal WHEN 'none' THEN 'no_equalization' ELSE 'th_equalization' END WHEN 1 THEN 'rgb_equalization' ELSE 'th_equalization' END AS expected FROM named)
SELECT * FROM e WHERE expected <> folder_regime"""


def c14(spark, d):
    keys = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type", "p_partkey").alias("run_key"))
    groups = table(spark, d, "part").filter("p_size < 10").select(F.concat_ws("/", "p_brand", "p_type").alias("group_key")).distinct()
    return T.trials_of(groups, keys).groupBy("group_key").agg(F.count("*").alias("n"))


def c16(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("full"))
    return rounded(T.distance_preservation(v.withColumn("part", F.slice("full", 1, 16)), "vec_id", "full", "part", F.col("vec_id") % 100 == 0), "spearman")


C16 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS f, embedding[1:16]::DOUBLE[] AS p FROM embeddings),
x AS (SELECT a.vec_id AS anchor, b.vec_id AS c, list_sum([(a.f[i] - b.f[i]) * (a.f[i] - b.f[i]) for i in range(1, 65)]) AS df, list_sum([(a.p[i] - b.p[i]) * (a.p[i] - b.p[i]) for i in range(1, 17)]) AS dp FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT anchor, row_number() OVER (PARTITION BY anchor ORDER BY df, c) AS rf, row_number() OVER (PARTITION BY anchor ORDER BY dp, c) AS rp FROM x) SELECT anchor, round(corr(rf, rp), 6) AS spearman FROM r GROUP BY anchor"""


def d12(spark, d):
    return rounded(T.method_metrics(part_runs(spark, d), F.col("equalization") == "th_equalization", ["value"]).withColumn("value_values", F.size("value_values")), "value_mean", "value_std", "value_median")


def d13(spark, d):
    return rounded(T.detection_per_method(runs(spark, d), "value"), "mean", "std", "median", "p90")


def d33(spark, d):
    return rounded(T.metric_table(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), "mean", "std", "cv", digits=4)


def d40(spark, d):
    s = events_as_samples(spark, d).groupBy("stype", "proxy", "alpha").agg(F.stddev_pop("raw").alias("sigma"))
    return rounded(T.sigma_shape(s, ["stype", "proxy"]), "low", "high", "ratio")


D40 = f"""WITH {SAMPLES}, s AS (SELECT stype, proxy, alpha, stddev_pop(raw) AS sigma FROM samples GROUP BY ALL)
SELECT stype, proxy, round(min(sigma), 6) AS low, round(max(sigma), 6) AS high, arg_min(alpha, sigma) AS alpha_low, arg_max(alpha, sigma) AS alpha_high, round(max(sigma) / min(sigma), 6) AS ratio FROM s GROUP BY ALL"""


def f4(spark, d):
    return T.order_methods(named(spark, d).groupBy("method").agg(F.count("*").alias("n")))


def h2(spark, d):
    n = named(spark, d).join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    methods, anchors = T.concat_slices([n.filter("p_size % 2 = 0").select("method", "p_size"), n.filter("p_size % 2 = 1").select("method", "p_brand")])
    return methods.withColumn("part", F.lit("methods")).unionByName(anchors.withColumn("part", F.lit("anchors"))).groupBy("part", "method").agg(F.count("*").alias("n"), F.count("p_size").alias("sized"), F.count("p_brand").alias("branded"))


def h4(spark, d):
    return T.name_sets(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select((F.col("doc_id") + 100).alias("doc_id")), "doc_id")


PLANS = {
    "b25_method_metadata": (b25, B25),
    "c5_merge_redundancy": (c5, f"WITH {RUNS}, o AS (SELECT method, count(*) / 10000 AS redundancy FROM runs GROUP BY method) SELECT run_id, method, redundancy FROM runs JOIN o USING (method)"),
    "c11_eq_mismatches": (c11, C11),
    "c14_trials_of": (c14, "WITH g AS (SELECT DISTINCT p_brand || '/' || p_type AS group_key FROM part WHERE p_size < 10) SELECT group_key, count(*) AS n FROM part JOIN g ON p_brand || '/' || p_type = group_key GROUP BY 1"),
    "c16_distance_preservation": (c16, C16),
    "d12_method_metrics": (d12, f"WITH {PART_RUNS} SELECT method, count(*) AS n_runs, count(*)::INT AS value_values, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, round(median(value), 6) AS value_median FROM runs WHERE equalization = 'th_equalization' GROUP BY method"),
    "d13_detection_per_method": (d13, f"WITH {RUNS} SELECT method, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(median(value), 6) AS median, round(avg(value) + 1.28 * coalesce(stddev_samp(value), 0), 6) AS p90 FROM runs GROUP BY method"),
    "d33_metric_table": (d33, "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, count(*) AS n, round(100 * stddev_pop(l_extendedprice) / avg(l_extendedprice), 4) AS cv FROM lineitem GROUP BY ALL"),
    "d40_sigma_shape": (d40, D40),
    "f4_order_methods": (f4, f"WITH {NAMED} SELECT method, count(*) AS n FROM named GROUP BY method"),
    "h2_concat_slices": (h2, f"WITH {NAMED} SELECT CASE WHEN method IN ('visible', 'lwir') THEN 'anchors' ELSE 'methods' END AS part, method, count(*) AS n, count(*) FILTER (p_size % 2 = 0) AS sized, count(*) FILTER (p_size % 2 = 1) AS branded FROM (SELECT n.*, p_size FROM named n JOIN part USING (p_partkey)) GROUP BY ALL"),
    "h4_name_sets": (h4, "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_a, b.doc_id IS NOT NULL AS in_b FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id + 100 AS doc_id FROM labels) b ON a.doc_id = b.doc_id"),
}
