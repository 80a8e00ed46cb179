"""Readers' row operators over the given tables as listings, lines and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolume.sources import annotations as A
from duolume.sources import archives as R

from .views import table


def listing(spark, d):
    """Orders as a file listing: folders with results, rebuilt results, markers, overrides."""
    o = F.col("o_orderkey")
    group = F.concat(F.lit("/a/g"), o % 7, F.lit("/m"), o % 11)
    run = F.when(o % 13 == 5, F.concat(F.lit("r"), F.col("o_custkey") % 50, F.lit("/npzfix/f"), o % 3)).otherwise(F.concat(F.lit("r"), F.col("o_custkey") % 50))
    name = F.when(o % 997 == 0, F.lit(R.IGNORE)).when(o % 3 == 0, F.lit(R.REBUILT)).when(o % 3 == 1, F.lit(R.RESULTS)).otherwise("other.txt")
    return table(spark, d, "orders").select(F.concat_ws("/", group, run, name).alias("path"), F.col("o_orderdate").alias("modificationTime"))


LISTING = f"""files AS (SELECT '/a/g' || (o_orderkey % 7) || '/m' || (o_orderkey % 11) || '/r' || (o_custkey % 50) || CASE WHEN o_orderkey % 13 = 5 THEN '/npzfix/f' || (o_orderkey % 3) ELSE '' END || '/' ||
  CASE WHEN o_orderkey % 997 = 0 THEN '{R.IGNORE}' WHEN o_orderkey % 3 = 0 THEN '{R.REBUILT}' WHEN o_orderkey % 3 = 1 THEN '{R.RESULTS}' ELSE 'other.txt' END AS path FROM orders)"""


def a1(spark, d):
    return R.discover_runs(listing(spark, d)).select("run_key", "name", "path", "model", F.array_join("group_path", "/").alias("group_path"), "val_override_path")


A1 = f"""WITH {LISTING}, n AS (SELECT path, string_split(path, '/')[-1] AS file, regexp_replace(path, '/[^/]*$', '') AS dir FROM files), marked AS (SELECT DISTINCT dir FROM n WHERE file = '{R.IGNORE}'),
f AS (SELECT dir, arg_max(path, (file = '{R.REBUILT}')::INT) AS path FROM n WHERE file IN ('{R.RESULTS}', '{R.REBUILT}') AND NOT EXISTS (SELECT 1 FROM marked m WHERE starts_with(n.path, m.dir || '/')) GROUP BY dir),
r AS (SELECT * FROM f WHERE dir NOT LIKE '%/npzfix/%'), x AS (SELECT regexp_replace(dir, '/npzfix/.*', '') AS dir, max(path) AS val_override_path FROM f WHERE dir LIKE '%/npzfix/%' GROUP BY 1)
SELECT ltrim(dir, '/') AS run_key, string_split(dir, '/')[-1] AS name, path, string_split(dir, '/')[-2] AS model, 'a/' || string_split(dir, '/')[3] AS group_path, val_override_path FROM r LEFT JOIN x USING (dir)"""


def a2(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("/cache/"), "p_brand", F.lit("/"), "p_partkey", F.when(F.col("p_size") % 2 == 0, F.lit(".yaml.cache")).otherwise(".txt")).alias("path"))
    return R.discover_cached(p, "/cache")


def a6(spark, d):
    name = F.element_at(F.array(*map(F.lit, R.REGIMES), F.lit("other")), (F.col("p_size") % 5 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lit("person")).otherwise("cyclist").alias("Class"), name.alias("Group Key"), F.when(F.col("p_partkey") % 2 == 0, F.lit("day")).otherwise("all").alias("Condition"))
    return R.load_training_results(rows).select("p_partkey")


def a8(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("method"), F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("reg"), F.when(F.col("event_id") % 15 == 0, None).otherwise(F.col("value")).alias("mi"))
    return R.proxy_table(rows, ["reg", "mi"], methods=["click", "view"], optional="reg").groupBy("method").agg(F.count("*").alias("n"), F.round(F.sum("mi"), 4).alias("mi"))


def a9(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("/d/set0"), F.col("p_size") % 9, F.lit("/V00"), F.col("p_partkey") % 5, F.when(F.col("p_partkey") % 3 == 0, F.lit("/lwir/I")).otherwise("/visible/I"), "p_partkey", F.when(F.col("p_size") % 4 == 0, F.lit(".txt")).otherwise(".PNG")).alias("path"))
    return A.list_visible(p, "kaist")


def a14(spark, d):
    line = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("person", "person?", "cyclist"))), (F.col("l_linenumber") % 3 + 1).cast("int")), F.col("l_partkey") % 600, F.col("l_suppkey"), F.col("l_quantity").cast("int"), F.col("l_linenumber") * 10, F.when(F.col("l_returnflag") == "R", F.lit("unpaired")))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), line.alias("value"))
    header = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit(A.BBGT_HEADER).alias("value"))
    return A.parse_bbgt(rows.unionByName(header)).groupBy("name").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("w").alias("w"), F.sum("h").alias("h"))


def a15(spark, d):
    line = F.concat_ws(" ", F.col("l_linenumber") % 3, "l_discount", "l_tax", F.when(F.col("l_returnflag") == "A", F.lit("bad")).otherwise(F.col("l_tax").cast("string")), "l_discount", F.when(F.col("l_suppkey") % 5 == 0, F.lit("0.5")))
    return A.parse_labels(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), line.alias("value"))).groupBy("cls").agg(F.count("*").alias("n"), F.round(F.sum("cx"), 4).alias("cx"), F.round(F.sum("nh"), 4).alias("nh"))


def b26(spark, d):
    return A.project_columns(table(spark, d, "region"), ["r_name", "missing", "r_regionkey"], {"r_name": "name"})


def b27(spark, d):
    words = table(spark, d, "nation").select(F.col("n_name").alias("label"), F.lit("up").alias("lang"), F.upper("n_name").alias("text")).filter("n_nationkey % 2 = 0")
    return A.translate(table(spark, d, "nation").select("n_nationkey", "n_name"), words, "n_name", "up")


def d38(spark, d):
    o = F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, ("best.pt", R.RESULTS, "validated_t", "log.txt", "x", "y", "z", R.IGNORE))), (o % 8 + 1).cast("int"))
    return R.eligible_runs(table(spark, d, "orders").select(F.concat(F.lit("/r/"), F.floor(o / 8) % 400 + F.when((o % 8).isin(2, 7), 300).otherwise(0), F.lit("/"), name).alias("path")), "t")


D38 = """WITH f AS (SELECT (o_orderkey // 8) % 400 + CASE WHEN o_orderkey % 8 IN (2, 7) THEN 300 ELSE 0 END AS k, o_orderkey % 8 AS n FROM orders)
SELECT '/r/' || k AS dir FROM f GROUP BY k HAVING bool_or(n = 0) AND bool_or(n = 1) AND NOT bool_or(n = 2) AND NOT bool_or(n = 7)"""


def h1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    parts = {"none": ("none", "none", docs.filter("lang = 'en'")), "rgb": ("clahe", "none", docs.filter("lang = 'fr'").withColumn("extra", F.lit(1)))}
    return R.combine_variants(parts).groupBy("variant", "eq_vis", "eq_th").agg(F.count("*").alias("n"), F.count("extra").alias("extra"))


def h3(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("run_key"), F.col("lang").alias("regime"), F.when(F.col("doc_id") % 4 == 0, F.lit("en")).otherwise(F.col("lang")).alias("folder_regime"), F.when(F.col("doc_id") % 5 == 0, F.lit("unknown_x")).otherwise("kaist").alias("dataset"), F.when(F.col("doc_id") % 6 == 0, F.lit("dusk")).otherwise("day").alias("condition"), F.when(F.col("doc_id") % 9 == 0, F.lit("unknown_option")).otherwise("o").alias("option"), F.when(F.col("doc_id") % 50 == 0, F.lit("broken")).alias("error"), F.sha2("text", 256).alias("content_hash"))
    return R.anomaly_report(rows).groupBy("kind").agg(F.count("*").alias("n"))


H3 = """SELECT 'regime_mismatch' AS kind, count(*) AS n FROM documents WHERE doc_id % 4 = 0 AND lang <> 'en' UNION ALL SELECT 'unknown_dataset', count(*) FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'unknown_condition', count(*) FROM documents WHERE doc_id % 6 = 0
  UNION ALL SELECT 'unknown_option', count(*) FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'error', count(*) FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT text) FROM documents"""

PLANS = {
    "a1_discover_runs": (a1, A1),
    "a2_discover_cached": (a2, "SELECT p_brand || '/' || p_partkey AS run_key, '/cache/' || p_brand || '/' || p_partkey || '.yaml.cache' AS path FROM part WHERE p_size % 2 = 0"),
    "a6_training_results": (a6, "SELECT p_partkey FROM part WHERE p_partkey % 6 = 0 AND p_size % 5 < 4"),
    "a8_proxy_table": (a8, "SELECT event_type AS method, count(*) AS n, round(sum(value), 4) AS mi FROM events WHERE event_type IN ('click', 'view') AND event_id % 10 <> 0 AND event_id % 15 <> 0 GROUP BY 1"),
    "a9_list_visible": (a9, "SELECT '/d/set0' || (p_size % 9) || '/V00' || (p_partkey % 5) || '/visible/I' || p_partkey || '.PNG' AS path, 'set0' || (p_size % 9) AS set, 'V00' || (p_partkey % 5) AS seq, 'I' || p_partkey || '.PNG' AS name FROM part WHERE p_partkey % 3 <> 0 AND p_size % 4 <> 0"),
    "a14_bbgt": (a14, "SELECT CASE l_linenumber % 3 WHEN 0 THEN 'person' ELSE 'cyclist' END AS name, count(*) AS n, sum(l_partkey % 600)::DOUBLE AS x, sum(trunc(l_quantity)) AS w, sum(l_linenumber * 10)::DOUBLE AS h FROM lineitem WHERE l_linenumber % 3 <> 1 AND l_returnflag <> 'R' GROUP BY 1"),
    "a15_labels": (a15, "SELECT l_linenumber % 3 AS cls, count(*) AS n, round(sum(l_discount), 4) AS cx, round(sum(l_discount), 4) AS nh FROM lineitem WHERE l_returnflag <> 'A' AND l_suppkey % 5 <> 0 GROUP BY 1"),
    "b26_project_columns": (b26, "SELECT r_name AS name, r_regionkey FROM region"),
    "b27_translate": (b27, "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE n_name END AS n_name FROM nation"),
    "d38_eligible_runs": (d38, D38),
    "h1_combine_variants": (h1, "SELECT 'none' AS variant, 'none' AS eq_vis, 'none' AS eq_th, count(*) AS n, 0 AS extra FROM documents WHERE lang = 'en' UNION ALL SELECT 'rgb', 'clahe', 'none', count(*), count(*) FROM documents WHERE lang = 'fr'"),
    "h3_anomalies": (h3, H3),
}
