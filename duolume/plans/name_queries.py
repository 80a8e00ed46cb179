"""Names and tags over parts as run names, pages as paths, events as times."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolume.functions import names as N

from .views import table

# names such as kaist_red_widget_day, with a device tag at times
NAMED = """named AS (SELECT p_partkey, ['kaist', 'llvip', 'coco'][1 + p_partkey % 3] || '_' || replace(p_name, ' ', '_') || ['_day', '_night', '_all', ''][1 + p_size % 4] AS name,
  ['', '_4090', '_GPU3090', '_12345678', '_GPU1'][1 + p_partkey % 5] AS tag, ['none', 'clahe', NULL][1 + p_size % 3] AS rgb, ['none', 'expand'][1 + p_partkey % 2] AS thermal,
  ['no_equalization', 'th_equalization', 'rgb_equalization', 'rgb_th_equalization'][1 + p_partkey % 4] AS regime, p_brand, p_type, p_name,
  ['visible', 'lwir', 'rgbt_v2', 'pca', 'wavelet', 'ssim', 'late_4ch', 'other'][1 + p_partkey % 8] AS method FROM part)"""


def named(spark, d):
    pick = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col(i) % len(values) + 1).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", F.concat(pick(("kaist", "llvip", "coco"), "p_partkey"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), pick(("_day", "_night", "_all", ""), "p_size")).alias("name"),
        pick(("", "_4090", "_GPU3090", "_12345678", "_GPU1"), "p_partkey").alias("tag"), pick(("none", "clahe", None), "p_size").alias("rgb"), pick(("none", "expand"), "p_partkey").alias("thermal"),
        pick(("no_equalization", "th_equalization", "rgb_equalization", "rgb_th_equalization"), "p_partkey").alias("regime"), "p_brand", "p_type", "p_name",
        pick(("visible", "lwir", "rgbt_v2", "pca", "wavelet", "ssim", "late_4ch", "other"), "p_partkey").alias("method"),
    )


def b1(spark, d):
    return named(spark, d).select("p_partkey", N.parse_name(F.col("name")).alias("n")).select("p_partkey", "n.*")


B1 = f"""WITH {NAMED}, s AS (SELECT p_partkey, string_split(name, '_') AS p FROM named), c AS (SELECT *, len(p) >= 2 AND p[-1] IN ('day', 'night', 'all') AS has FROM s)
SELECT p_partkey, p[1] AS dataset, array_to_string(p[2:(len(p) - CASE WHEN has THEN 1 ELSE 0 END)], '_') AS method, CASE WHEN has THEN p[-1] ELSE '' END AS condition FROM c"""


def b2(spark, d):
    return named(spark, d).select("p_partkey", N.clean_tags(F.concat("name", "tag")).alias("clean"))


B2 = f"WITH {NAMED} SELECT p_partkey, " + "regexp_replace(" * len(N.DEVICE_TAGS) + "name || tag" + "".join(f", '{t}', '', 'g')" for t in N.DEVICE_TAGS) + " AS clean FROM named"


def b3(spark, d):
    rows = named(spark, d)
    return rows.select("p_partkey", N.build_key(F.array("regime", "method"), F.col("p_brand"), F.col("name")).alias("key"), N.build_label(F.col("method"), F.concat("p_brand", F.lit("_sameseed"))).alias("label"))


B3 = f"WITH {NAMED} SELECT p_partkey, regime || '/' || method || '/' || p_brand || '/' || name AS key, upper(method) || ' (' || p_brand || ')' AS label FROM named"


def b4(spark, d):
    return named(spark, d).select("p_partkey", N.condition_of(F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("night")).otherwise(""), "name")).alias("condition"))


B4 = f"""WITH {NAMED}, s AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'night' ELSE '' END || name AS n FROM named), p AS (SELECT *, string_split(n, '_') AS p FROM s)
SELECT p_partkey, CASE WHEN len(p) >= 2 AND p[-1] IN ('day', 'night', 'all') THEN p[-1] WHEN contains(p[1], 'night') THEN 'night' WHEN contains(p[1], 'day') THEN 'day' WHEN contains(p[1], 'all') THEN 'all' ELSE 'Unknown' END AS condition FROM p"""


def b5(spark, d):
    path = F.concat(F.lit("/data/set"), F.lpad((F.col("l_orderkey") % 14).cast("string"), 2, "0"), F.lit("/V000/visible/I"), F.col("l_linenumber"))
    dataset = F.when(F.col("l_suppkey") % 3 == 0, F.lit("llvip")).when(F.col("l_suppkey") % 3 == 1, F.lit("kaist")).otherwise("coco")
    rows = table(spark, d, "lineitem").select(N.infer_condition(path, dataset).alias("condition"), dataset.alias("dataset"), N.lwir_path(path).alias("path"))
    return rows.groupBy("dataset", "condition").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))


B5 = """WITH p AS (SELECT l_orderkey % 14 AS s, CASE l_suppkey % 3 WHEN 0 THEN 'llvip' WHEN 1 THEN 'kaist' ELSE 'coco' END AS dataset, '/data/set' || lpad((l_orderkey % 14)::VARCHAR, 2, '0') || '/V000/lwir/I' || l_linenumber AS path FROM lineitem)
SELECT dataset, CASE WHEN dataset = 'llvip' THEN 'night' WHEN dataset = 'coco' OR s > 11 THEN 'unknown' WHEN s IN (0, 1, 2, 6, 7, 8) THEN 'day' ELSE 'night' END AS condition, count(*) AS n, count(DISTINCT path) AS paths FROM p GROUP BY ALL"""


def b6(spark, d):
    rows = named(spark, d).select("p_partkey", N.eq_regime(F.col("rgb"), F.col("thermal")).alias("regime"))
    return rows.withColumn("e", N.eq_labels(F.col("regime"))).select("p_partkey", "regime", "e.*")


B6 = f"""WITH {NAMED}, r AS (SELECT p_partkey, coalesce(rgb, 'none') <> 'none' AS a, thermal <> 'none' AS b FROM named)
SELECT p_partkey, CASE WHEN a AND b THEN 'rgb_th_equalization' WHEN a THEN 'rgb_equalization' WHEN b THEN 'th_equalization' ELSE 'no_equalization' END AS regime, CASE WHEN a THEN 'clahe' ELSE 'none' END AS eq_vis,
  CASE WHEN b THEN 'clahe' ELSE 'none' END AS eq_th, CASE WHEN a AND b THEN 'RGB+TH' WHEN a THEN 'RGB' WHEN b THEN 'TH' ELSE '-' END AS shown FROM r"""


def b7(spark, d):
    return named(spark, d).select("p_partkey", N.eq_from_text(F.when(F.col("p_partkey") % 9 > 0, F.concat(F.lit("Runs/"), F.upper("regime"), F.lit("/x")))).alias("regime"))


B7 = f"WITH {NAMED} SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN regime END AS regime FROM named"


def b8(spark, d):
    tag = F.when(F.col("p_partkey") % 3 == 0, F.lit("kaist_full")).when(F.col("p_partkey") % 3 == 1, F.lit("unknown_x"))
    return named(spark, d).select("p_partkey", N.infer_dataset(tag, F.col("name"), F.when(F.col("p_partkey") % 2 == 0, F.lit("split_80_20"))).alias("dataset"))


B8 = f"""WITH {NAMED} SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kaist_full' ELSE CASE WHEN contains(name, 'kaist') THEN 'kaist' WHEN contains(name, 'llvip') THEN 'llvip' WHEN contains(name, 'coco') THEN 'coco' ELSE 'unknown' END
  || '_' || CASE WHEN p_partkey % 2 = 0 THEN '80_20' ELSE 'unknown_split' END END AS dataset FROM named"""


def b9(spark, d):
    condition = F.element_at(F.array(*[F.lit(x) for x in ("Day", "night", "unknown_condition_1", "dusk")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return named(spark, d).select("p_partkey", N.normalize_condition(condition, F.col("name")).alias("condition"))


B9 = f"""WITH {NAMED} SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'night' WHEN 3 THEN 'dusk' ELSE CASE WHEN contains(name, 'day') THEN 'day' WHEN contains(name, 'night') THEN 'night' ELSE 'unknown_condition_1' END END AS condition FROM named"""


def b10(spark, d):
    train = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/data/images/"), "method"))
    return named(spark, d).select("p_partkey", N.infer_option(train, F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("runs/"), "name"))).alias("option"))


B10 = f"WITH {NAMED} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN method WHEN p_partkey % 3 > 0 THEN string_split(name, '_')[2] ELSE 'unknown_option' END AS option FROM named"


def b11(spark, d):
    path = F.concat(F.lit("regime/variance_kaist_"), F.split_part("method", F.lit("_"), F.lit(1)), F.element_at(F.array(*[F.lit(x) for x in ("_max_day", "_red_day", "_v2_night", "")]), (F.col("p_partkey") / 8 % 4 + 1).cast("int")))
    return named(spark, d).select("p_partkey", N.normalize_fusion(F.split_part("method", F.lit("_"), F.lit(1)), path, F.lit("day")).alias("fusion"))


B11 = f"""WITH {NAMED} SELECT p_partkey, split_part(method, '_', 1) || CASE (p_partkey // 8) % 4 WHEN 0 THEN '_max' WHEN 2 THEN '_v2' ELSE '' END AS fusion FROM named"""


def b12(spark, d):
    path = F.concat_ws("/", "regime", F.concat(F.lit("variance_"), "method"), F.when(F.col("p_partkey") % 3 == 0, F.lit("variance_th_equalization")).otherwise("run1"))
    return named(spark, d).select("p_partkey", N.normalize_path(path).alias("path"))


B12 = f"WITH {NAMED} SELECT p_partkey, regime || '/variance_' || method || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/run1' END AS path FROM named"


def b13(spark, d):
    rows = named(spark, d).select("p_partkey", N.fusion_family(F.col("method")).alias("family"), N.method_rank(F.col("method")).alias("r"))
    return rows.select("p_partkey", "family", F.col("r.col1").alias("family_rank"), F.col("r.col2").alias("place"))


B13 = f"""WITH {NAMED}, f(method, family, family_rank, place) AS (VALUES ('visible', 'reference', 0, 0), ('lwir', 'reference', 0, 1), ('rgbt_v2', 'static_fusion', 1, 1), ('pca', 'reprojection_variance', 2, 0), ('wavelet', 'reprojection_freq', 3, 0), ('ssim', 'alpha', 4, 0), ('late_4ch', 'dl_fusion', 5, 2))
SELECT p_partkey, coalesce(family, '__unknown__') AS family, coalesce(family_rank, 6) AS family_rank, coalesce(place, 999) AS place FROM named LEFT JOIN f USING (method)"""


def b24(spark, d):
    return named(spark, d).select("p_partkey", N.fingerprint(F.col("method"), F.col("name"), F.col("p_brand")).alias("key"), N.fingerprint(F.col("name"), n=6).alias("short"))


B24 = f"WITH {NAMED} SELECT p_partkey, substr(sha256(method || '|' || name || '|' || p_brand), 1, 12) AS key, substr(sha256(name), 1, 6) AS short FROM named"


def b29(spark, d):
    cells = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_size").alias("m"), F.stddev_pop("p_size").alias("s"))
    return cells.select("p_brand", N.fmt_pm(F.round("m", 8), F.round("s", 8), 2).alias("shown"))


def b30(spark, d):
    return table(spark, d, "events").select("event_id", N.fmt_ts(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("stamp"))


def b31(spark, d):
    e = table(spark, d, "events")
    return e.filter(N.in_time_window(F.col("ts"), "15:30", "06:00")).groupBy("event_type").agg(F.count("*").alias("n"))


def b32(spark, d):
    rows = table(spark, d, "part").select("p_partkey", N.to_number(F.element_at(F.split(F.concat_ws(" ", "p_size", "p_name"), " "), (F.col("p_partkey") % 2 + 1).cast("int"))).alias("value"))
    return rows.dropna(subset=["value"])


def b34(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("delta"), F.min("value").alias("t"), F.max("value").alias("v"))
    return e.select("user_id", F.round(N.anchor_map(F.col("delta"), F.col("v"), F.col("t")), 6).alias("score"))


PLANS = {
    "b1_parse_name": (b1, B1), "b2_clean_tags": (b2, B2), "b3_key_label": (b3, B3), "b4_condition": (b4, B4), "b5_condition_of_path": (b5, B5), "b6_regime": (b6, B6), "b7_regime_from_text": (b7, B7), "b8_infer_dataset": (b8, B8),
    "b9_normalize_condition": (b9, B9), "b10_infer_option": (b10, B10), "b11_normalize_fusion": (b11, B11), "b12_normalize_path": (b12, B12), "b13_family_rank": (b13, B13), "b24_fingerprint": (b24, B24),
    "b29_mean_spread": (b29, "SELECT p_brand, printf('%.2f±%.2f', round(avg(p_size), 2), round(stddev_pop(p_size), 2)) AS shown FROM part GROUP BY p_brand"),
    "b30_timestamp": (b30, "SELECT event_id, strftime(ts, '%Y-%m-%d_%H:%M:%S') AS stamp FROM events"),
    "b31_time_window": (b31, "SELECT event_type, count(*) AS n FROM events WHERE strftime(ts, '%H:%M') >= '15:30' OR strftime(ts, '%H:%M') <= '06:00' GROUP BY event_type"),
    "b32_to_number": (b32, "SELECT p_partkey, p_size::DOUBLE AS value FROM part WHERE p_partkey % 2 = 0"),
    "b34_anchor_map": (b34, "SELECT user_id, round(CASE WHEN abs(max(value) - min(value)) < 1e-8 THEN 50 ELSE greatest(0, least(100, 100 * (avg(value) - min(value)) / (max(value) - min(value)))) END, 6) AS score FROM events GROUP BY user_id"),
}
