"""Statistics over line items, events and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolume.operators import stats as S

from .run_queries import rounded
from .views import PART_RUNS, part_runs, runs, table

X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def d11(spark, d):
    return rounded(S.anova2(runs(spark, d), "method", "equalization", "value"), "sum_sq", "f", "p", digits=4).select("term", "sum_sq", "df", "f")


def d11_families(spark, d):
    return rounded(S.anova2(part_runs(spark, d), "family", "equalization", "value"), "sum_sq", "f", "p", digits=4)


def d11_within(spark, d):
    rows = part_runs(spark, d).withColumn("kind", F.element_at(F.split("family", " "), 1))
    return rounded(S.anova2_within(rows, "kind", "method", "equalization", "value"), "sum_sq", "f", "p", digits=4)


def d14(spark, d):
    return rounded(S.pca_report(table(spark, d, "lineitem"), X).drop("loadings"), "eigenvalue", "explained", "cumulative", "broken_stick")


def d15(spark, d):
    scored = S.pca_scores(table(spark, d, "lineitem"), X, 3)
    return rounded(scored.groupBy("l_returnflag").agg(*[f(f"PC{i}").alias(f"PC{i}_{s}") for i in (1, 2, 3) for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))]), *[f"PC{i}_{s}" for i in (1, 2, 3) for s in ("mean", "std")])


def d16(spark, d):
    return rounded(S.nested_ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]).select("model", "r2", F.get("betas", 0).alias("intercept"), F.get("betas", 1).alias("slope"), "n"), "r2", "intercept", "slope", digits=5)


def d16_nested(spark, d):
    return S.nested_ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


def d17(spark, d):
    return rounded(S.slice_corr(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), "corr_l_quantity", "corr_l_discount", "corr_l_tax")


D17 = "SELECT l_returnflag, l_linestatus, count(*) AS n, " + ", ".join(f"round(corr({x}, l_extendedprice), 6) AS corr_{x}" for x in ("l_quantity", "l_discount", "l_tax")) + " FROM lineitem GROUP BY ALL HAVING count(*) >= 3"


def d18(spark, d):
    r = part_runs(spark, d)
    latent = table(spark, d, "part").groupBy(F.col("p_brand").alias("method")).agg(F.avg("p_size").alias("latent"))
    return rounded(S.training_vs_latent(r, latent, "method"), "slope", "intercept", "pearson", "spearman")


D18 = f"""WITH {PART_RUNS}, p AS (SELECT method, avg(value) + 1.28155 * coalesce(stddev_samp(value), 0) AS p90 FROM runs GROUP BY method), l AS (SELECT p_brand AS method, avg(p_size) AS latent FROM part GROUP BY p_brand),
j AS (SELECT *, row_number() OVER (ORDER BY p90, method) AS a, row_number() OVER (ORDER BY latent, method) AS b FROM p JOIN l USING (method))
SELECT count(*) AS n, round(regr_slope(p90, latent), 6) AS slope, round(regr_intercept(p90, latent), 6) AS intercept, round(corr(p90, latent), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM j HAVING count(*) >= 3"""


def e6(spark, d):
    return rounded(S.spearman(table(spark, d, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")), ["l_suppkey"], "l_quantity", "l_extendedprice", "key"), "spearman")


E6 = """WITH k AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS key FROM lineitem),
r AS (SELECT l_suppkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, key) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, key) AS b FROM k)
SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) < 2 OR stddev_pop(l_quantity) < 1e-12 OR stddev_pop(l_extendedprice) < 1e-12 THEN 0 ELSE corr(a, b) END, 6) AS spearman FROM r GROUP BY l_suppkey"""


def c3(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("quantity"))
    return rounded(S.join_scores(q.withColumnRenamed("l_partkey", "p_partkey"), table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey"), "quantity")


def c4(spark, d):
    return S.key_diff(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select((F.col("doc_id") * 3).alias("doc_id")), "doc_id")


C4 = """WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id * 3 AS doc_id FROM labels)
SELECT doc_id, 'left' AS only_in FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'right' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)"""


def c10(spark, d):
    knots = table(spark, d, "events").groupBy((F.col("user_id") % 11).cast("double").alias("knot_x")).agg(F.median("value").alias("knot_y"))
    return rounded(S.interp(table(spark, d, "events").select("event_id", (F.col("value") / 30).alias("x")), knots, "x", "y"), "y").select("event_id", "y")


C10 = """WITH k AS (SELECT (user_id % 11)::DOUBLE AS kx, median(value) AS ky FROM events GROUP BY 1), s AS (SELECT kx, ky, lead(kx) OVER (ORDER BY kx) AS nx, lead(ky) OVER (ORDER BY kx) AS ny FROM k),
e AS (SELECT event_id, value / 30 AS x FROM events), m AS (SELECT min(kx) AS lo, max(kx) AS hi, arg_min(ky, kx) AS ly, arg_max(ky, kx) AS hy FROM k)
SELECT event_id, round(CASE WHEN x < lo THEN ly WHEN x >= hi THEN hy ELSE (SELECT ky + (ny - ky) * (x - kx) / (nx - kx) FROM s WHERE x >= kx AND x < nx) END, 6) AS y FROM e, m"""


def c15(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("full"))
    return rounded(S.knn_preservation(v.withColumn("part", F.slice("full", 1, 16)), "vec_id", "full", "part", F.col("vec_id") % 100 == 0), "kept")


C15 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS f, embedding[1:16]::DOUBLE[] AS p FROM embeddings),
x AS (SELECT a.vec_id AS q, b.vec_id AS c, list_sum([(a.f[i] - b.f[i]) * (a.f[i] - b.f[i]) for i in range(1, 65)]) AS df, list_sum([(a.p[i] - b.p[i]) * (a.p[i] - b.p[i]) for i in range(1, 17)]) AS dp FROM v a, v b WHERE a.vec_id % 100 = 0),
r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY df, c) AS rf, row_number() OVER (PARTITION BY q ORDER BY dp, c) AS rp FROM x)
SELECT q, round(count(*) FILTER (rf <= 10 AND rp <= 10) / 10.0, 6) AS kept FROM r GROUP BY q"""

PLANS = {
    "d11_anova": (d11, None), "d11_families": (d11_families, None), "d11_within_families": (d11_within, None), "d14_pca_report": (d14, None), "d15_pca_scores": (d15, None),
    "d16_ols": (d16, "SELECT 'l_quantity' AS model, round(regr_r2(l_extendedprice, l_quantity), 5) AS r2, round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, count(*) AS n FROM lineitem"),
    "d16_nested_ols": (d16_nested, None), "d17_slice_corr": (d17, D17), "d18_training_vs_latent": (d18, D18), "e6_spearman": (e6, E6),
    "c3_join_scores": (c3, "SELECT p_partkey, round(avg(l_quantity), 6) AS quantity, any_value(p_retailprice) AS p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey"),
    "c4_key_diff": (c4, C4), "c10_interp": (c10, C10), "c15_knn_preservation": (c15, C15),
}
