"""Fields of records, runs with their logs, and fields that calibration adds, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolume.functions.names import metric
from duolume.operators import calibration as C
from duolume.operators import tables as T
from duolume.sources import archives as R

from .run_queries import rounded
from .views import table


def b28(spark, d):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    m = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("P"), size)).when(F.col("p_partkey") % 3 == 1, F.create_map(F.lit("mP"), price)).otherwise(F.create_map(F.lit("P"), size, F.lit("mP"), price))
    return table(spark, d, "part").select("p_partkey", metric(m, "P").alias("value"))


def b33(spark, d):
    k = F.col("event_id") % 20
    odd = F.when(k == 3, None).when(k == 7, F.lit(float("nan"))).when(k == 11, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = R.drop_nonfinite(table(spark, d, "events").select("event_type", odd.alias("value")), ["value"])
    return rounded(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


def runs_with_logs(spark, d):
    """Orders as results, their lines as epochs, and arguments of two orders in three."""
    o = table(spark, d, "orders")
    epochs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dir"), F.col("l_linenumber").alias("epoch"), F.col("l_quantity").alias("loss"))
    args = R.read_args(o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 64).alias("batch"), (F.col("o_orderkey") % 2 == 0).alias("deterministic"), "o_totalprice"))
    return R.assemble_runs(o.select(F.col("o_orderkey").alias("dir"), "o_totalprice"), epochs, args.withColumnRenamed("path", "dir"))


def c2(spark, d):
    e = F.col("epochs")
    return runs_with_logs(spark, d).select("dir", "batch", "deterministic", F.when(e.isNotNull(), F.size(e)).alias("n_epochs"), F.get(e, 0)["epoch"].alias("first_epoch"), F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + x["loss"]), 4).alias("loss"))


C2 = """WITH e AS (SELECT l_orderkey AS dir, count(*) AS n_epochs, min(l_linenumber) AS first_epoch, round(sum(l_quantity), 4) AS loss FROM lineitem GROUP BY 1)
SELECT o_orderkey AS dir, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 64 END AS batch, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 2 = 0 END AS deterministic, n_epochs, first_epoch, loss FROM orders LEFT JOIN e ON e.dir = o_orderkey"""


def a7(spark, d):
    regime = lambda c, k: F.when(F.col("p_size") % k == 0, F.lit("clahe")).otherwise("none").alias(c)
    rows = table(spark, d, "part").select("p_partkey", regime("eq_vis", 3), regime("eq_th", 4), (F.col("p_retailprice") % 100).alias("reg_mean"), (F.col("p_retailprice") % 90).alias("raw_mean"), (F.col("p_size") / 50).alias("latent_z_mean"))
    return rounded(R.load_overview(rows, "none", "clahe").select("p_partkey", "thermal_share_raw", "thermal_share_reg", "calibration_lift"), "thermal_share_raw", "thermal_share_reg", "calibration_lift")


def by_type(spark, d, where):
    rows = table(spark, d, "events").filter(where)
    return rows.groupBy(F.col("event_type").alias("proxy")).agg(F.sum("value").alias("w"))


def d4(spark, d):
    knots = F.array(*[F.struct(F.lit(float(x)).alias("knot_x"), F.lit(y).alias("knot_y")) for x, y in ((0, 0.0), (20, 0.25), (60, 0.5), (100, 1.0))])
    means = table(spark, d, "events").groupBy("user_id").agg(F.avg(F.col("value") % 120 - 10).alias("vis_mean"))
    return rounded(T.recalibrate_means(means, knots, "vis_mean", "latent_z_mean"), "vis_mean", "latent_z_mean")


D4 = """WITH m AS (SELECT user_id, avg(value % 120 - 10) AS v FROM events GROUP BY 1)
SELECT user_id, round(v, 6) AS vis_mean, round(1 - CASE WHEN v < 0 THEN 0 WHEN v < 20 THEN 0.0125 * v WHEN v < 60 THEN 0.25 + 0.00625 * (v - 20) WHEN v < 100 THEN 0.5 + 0.0125 * (v - 60) ELSE 1 END, 6) AS latent_z_mean FROM m"""


def d41(spark, d):
    return rounded(C.weight_shift(by_type(spark, d, "user_id % 2 = 0 and event_type <> 'view'"), by_type(spark, d, "user_id % 2 = 1"), "proxy"), "w_a", "w_b", "shift", digits=4)


D41 = """WITH a AS (SELECT event_type AS proxy, sum(value) AS w FROM events WHERE user_id % 2 = 0 AND event_type <> 'view' GROUP BY 1), b AS (SELECT event_type AS proxy, sum(value) AS w FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT proxy, round(a.w, 4) AS w_a, round(b.w, 4) AS w_b, round(CASE WHEN a.w > 0 THEN 100 * (b.w - a.w) / a.w END, 4) AS shift FROM a FULL JOIN b USING (proxy)"""


def q21(spark, d):
    known = table(spark, d, "customer").filter("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("latent_z"))
    return rounded(T.with_calibration(table(spark, d, "nation").select("n_nationkey", "n_name"), known, ["n_nationkey"]), "latent_z", digits=4)


def q23(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("method"), F.col("event_id").alias("image_id"), (F.col("value") % 100).alias("reg"), (F.col("user_id") % 11 / 10).alias("latent_z"), (F.col("user_id") % 7 / 10).alias("latent_z_alpha_dep"))
    return rounded(T.reg_crosscheck(rows), "reg_share", "latent_z", "latent_z_alpha_dep", "difference")


PLANS = {
    "b28_metric": (b28, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_retailprice ELSE p_size::DOUBLE END AS value FROM part"),
    "b33_drop_nonfinite": (b33, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 20 NOT IN (3, 7, 11) GROUP BY 1"),
    "a7_overview": (a7, "SELECT p_partkey, round(1 - (p_retailprice % 90) / 100, 6) AS thermal_share_raw, round(1 - (p_retailprice % 100) / 100, 6) AS thermal_share_reg, round(p_size / 50 - (1 - (p_retailprice % 100) / 100), 6) AS calibration_lift FROM part WHERE p_size % 3 <> 0 AND p_size % 4 = 0"),
    "c2_runs_with_logs": (c2, C2), "d4_recalibrate": (d4, D4), "d41_weight_shift": (d41, D41),
    "q21_with_calibration": (q21, "SELECT n_nationkey, n_name, round(avg(c_acctbal), 4) AS latent_z FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 3 <> 0 GROUP BY ALL"),
    "q23_crosscheck": (q23, "SELECT event_type AS method, event_id AS image_id, round(1 - (value % 100) / 100, 6) AS reg_share, round((user_id % 11) / 10, 6) AS latent_z, round((user_id % 7) / 10, 6) AS latent_z_alpha_dep, round((user_id % 11) / 10 - (1 - (value % 100) / 100), 6) AS difference FROM events"),
}
