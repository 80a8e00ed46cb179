"""Run analytics over events and parts as runs, and vectors as curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolume.functions import names as N
from duolume.operators import runs as R

from .views import CURVES, MISS_CURVES, PART_RUNS, RUNS, curves, miss_curves, part_runs, runs, table


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


CELLS = """cells AS (SELECT method, equalization, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, median(value) AS median, max(value) AS best,
  avg(value) + 1.28 * coalesce(stddev_samp(value), 0) AS p90 FROM runs WHERE value IS NOT NULL GROUP BY method, equalization)"""


def d7(spark, d):
    return rounded(R.build_cells(runs(spark, d)).drop("value"), "mean", "std", "median", "best", "p90")


def d8_means(spark, d):
    return rounded(R.regime_means(R.build_cells(runs(spark, d))), "mean")


def d8(spark, d):
    return rounded(R.pivot_cells(R.build_cells(runs(spark, d))), *N.REGIMES)


def d9(spark, d):
    return rounded(R.delta_vs_baseline(R.build_cells(runs(spark, d))), "value", "base", "delta", "noise")


def d10(spark, d):
    return R.keep_covered(part_runs(spark, d), 4).groupBy("method").agg(F.count("*").alias("n"))


def d6(spark, d):
    return rounded(R.averaged_table(part_runs(spark, d), ["method", "equalization"], ["value"]), "value_mean", "value_std")


def d1(spark, d):
    m = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(R.summarize(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], m), *[f"{c}_{s}" for c in m for s in ("mean", "median", "std")], digits=4)


D1 = "SELECT l_returnflag, l_linestatus, " + ", ".join(
    f"round(avg({c}), 4) AS {c}_mean, round(median({c}), 4) AS {c}_median, round(stddev_pop({c}), 4) AS {c}_std, count({c}) AS {c}_n" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
) + " FROM lineitem GROUP BY ALL"


def d2(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.create_map(F.lit("quantity"), "l_quantity", F.lit("discount"), "l_discount", F.lit("tax"), "l_tax").alias("weights"))
    return rounded(R.summarize_map(rows, ["l_returnflag"], "weights"), "mean", "std")


D2 = """SELECT l_returnflag, name, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, count(w) AS n FROM (
  SELECT l_returnflag, unnest(['quantity', 'discount', 'tax']) AS name, unnest([l_quantity, l_discount, l_tax]) AS w FROM lineitem) GROUP BY ALL"""


def d3(spark, d):
    rows = runs(spark, d).withColumn("converged", F.col("value") < 100)
    return rounded(R.mode_counts(rows, ["method"], "equalization", "converged"), "rate")


D3 = f"""WITH {RUNS}, c AS (SELECT method, equalization, count(*) AS c FROM runs GROUP BY ALL),
b AS (SELECT method, equalization AS mode, c AS mode_n, row_number() OVER (PARTITION BY method ORDER BY c DESC, equalization) AS k FROM c)
SELECT r.method, round(avg(CASE WHEN value < 100 THEN 1.0 ELSE 0.0 END), 6) AS rate, any_value(mode) AS mode, any_value(mode_n) AS mode_n FROM runs r JOIN b ON b.method = r.method AND k = 1 GROUP BY r.method"""


def d19(spark, d):
    return rounded(R.normal_percentile(runs(spark, d), ["method", "equalization"], "value", 90), "percentile")


Z90 = 1.2815515655446004
D19 = f"""WITH {RUNS} SELECT method, equalization, count(value) AS n, round(CASE WHEN count(value) = 0 THEN 0 WHEN count(value) = 1 OR coalesce(stddev_samp(value), 0) = 0 THEN avg(value) ELSE avg(value) + {Z90} * stddev_samp(value) END, 6) AS percentile FROM runs GROUP BY ALL"""


def d20(spark, d):
    return rounded(R.normal_percentile(curves(spark, d), ["label", "pt"], "value", 75), "percentile")


Z75 = 0.6744897501960818
D20 = f"""WITH {CURVES} SELECT label, pt, count(value) AS n, round(CASE WHEN count(value) = 0 THEN 0 WHEN count(value) = 1 OR coalesce(stddev_samp(value), 0) = 0 THEN avg(value) ELSE avg(value) + {Z75} * stddev_samp(value) END, 6) AS percentile FROM curves GROUP BY ALL"""


def d21(spark, d):
    r = part_runs(spark, d)
    first = R.best_trials(r.withColumn("zero", F.lit(0)), "method", "zero", "run_id").select("method", F.col("run_id").alias("reference_run"), "family")
    return rounded(R.normal_percentile(r, ["method"], "value", 90).join(first, "method").withColumn("epoch", F.lit("-")), "percentile")


D21 = f"""WITH {PART_RUNS} SELECT method, count(value) AS n, round(CASE WHEN count(value) = 1 OR coalesce(stddev_samp(value), 0) = 0 THEN avg(value) ELSE avg(value) + {Z90} * stddev_samp(value) END, 6) AS percentile,
  min(run_id) AS reference_run, arg_min(family, run_id) AS family, '-' AS epoch FROM runs GROUP BY method"""


def d22(spark, d):
    return rounded(R.curve_envelope(curves(spark, d).withColumn("hours", F.col("vec_id") / 10), ["label"], "hours"), "mean", "low", "high", "mean_duration")


def d23(spark, d):
    return rounded(R.metric_density(runs(spark, d), ["method"], "value"), "density", "low", "high", "mean", "std", digits=8)


def d23_normal(spark, d):
    return rounded(R.normal_curve(runs(spark, d), ["method"], "value"), "x", "density", digits=8)


D23_NORMAL = f"""WITH {RUNS}, f AS (SELECT method, avg(value) AS mean, stddev_pop(value) AS std FROM runs GROUP BY 1), g AS (SELECT *, unnest(range(201)) AS pt FROM f WHERE std > 0)
SELECT method, pt, round(mean + (pt - 100) / 25 * std, 8) AS x, round(exp(-pow((pt - 100) / 25, 2) / 2) / (std * sqrt(2 * pi())), 8) AS density, CASE WHEN pt % 25 = 0 THEN ((pt - 100) // 25)::INT END AS mark FROM g"""


D23 = f"""WITH {RUNS}, e AS (SELECT method, value, min(value) OVER (PARTITION BY method) AS low, max(value) OVER (PARTITION BY method) AS high FROM runs WHERE value IS NOT NULL),
b AS (SELECT *, CASE WHEN high = low THEN 0 ELSE least(floor((value - low) / ((high - low) / 9)), 8) END::BIGINT AS bin FROM e),
c AS (SELECT method, bin, count(*) AS n, any_value(low) AS low, any_value(high) AS high FROM b GROUP BY method, bin), f AS (SELECT method, avg(value) AS mean, stddev_pop(value) AS std FROM runs GROUP BY 1)
SELECT method, bin, n, round(mean, 8) AS mean, round(std, 8) AS std, round(low, 8) AS low, round(high, 8) AS high, round(n / sum(n) OVER (PARTITION BY method) / ((high - low) / 9), 8) AS density FROM c JOIN f USING (method)"""


def d24(spark, d):
    return rounded(R.lamr(miss_curves(spark, d), ["vec_id"]), "lamr")


D24 = f"""WITH {MISS_CURVES}, s AS (SELECT *, lead(fppi) OVER w AS nf, lead(mr) OVER w AS nm FROM miss WINDOW w AS (PARTITION BY vec_id ORDER BY fppi, mr)),
e AS (SELECT vec_id, min(fppi) AS first, max(fppi) AS last, arg_max(mr, fppi) AS lm FROM miss GROUP BY vec_id),
p AS (SELECT *, unnest([10 ** (-2 + i * 0.25) for i in range(9)]) AS ref FROM e),
a AS (SELECT p.vec_id, p.ref, p.first, p.last, p.lm, (SELECT mr + (nm - mr) * (p.ref - fppi) / (nf - fppi) FROM s WHERE s.vec_id = p.vec_id AND p.ref >= fppi AND p.ref < nf) AS hit FROM p)
SELECT vec_id, round(exp(avg(ln(greatest(coalesce(hit, CASE WHEN ref < first THEN 1 WHEN ref = last THEN lm ELSE 0 END), 1e-10)))), 6) AS lamr FROM a GROUP BY vec_id"""


def d25(spark, d):
    return rounded(R.lamr_step(miss_curves(spark, d), ["vec_id"]), "lamr")


D25 = f"""WITH {MISS_CURVES}, p AS (SELECT *, unnest([10 ** (-2 + i * 0.25) for i in range(9)]) AS ref FROM miss),
a AS (SELECT vec_id, ref, arg_max(mr, fppi) FILTER (fppi <= ref) AS hit FROM p GROUP BY ALL)
SELECT vec_id, round(exp(avg(ln(greatest(coalesce(hit, 1.0), 1e-10)))), 6) AS lamr FROM a GROUP BY vec_id"""


def d26(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("r"))
    got = R.miss_rate(e.withColumns({"r_plot": F.col("r"), "fppi_plot": F.col("r"), "max_f1_index": (F.col("vec_id") % 64).cast("int")}))
    return rounded(got.select("vec_id", F.aggregate("mr", F.lit(0.0), lambda a, x: a + x).alias("sum_mr"), "fppi"), "sum_mr", "fppi")


D26 = "SELECT vec_id, round(list_sum([1 - abs(x::DOUBLE) for x in embedding]), 6) AS sum_mr, round(abs(embedding[1 + vec_id % 64]::DOUBLE), 6) AS fppi FROM embeddings"


def e1(spark, d):
    return R.best_trials(runs(spark, d).withColumn("cell", F.concat_ws("/", "method", "equalization")), "cell", "value", "run_id").select("cell", "run_id", "value")


def e2(spark, d):
    return R.top_k(runs(spark, d), ["equalization"], "value", "run_id", 10).select("equalization", "method", "run_id", "value", "rank")


def e3(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("name"), "doc_id")
    return R.dedup_first(docs, "name", "doc_id")


def e12(spark, d):
    methods = part_runs(spark, d).select("method", "family").distinct()
    return R.boundaries(methods, ["family", "method"], "family")


E12 = f"""WITH {PART_RUNS}, m AS (SELECT DISTINCT method, family FROM runs) SELECT method, family, coalesce(lag(family) OVER (ORDER BY family, method) <> family, true) AS starts FROM m"""


def e13(spark, d):
    return rounded(R.order_labels(runs(spark, d), "method", "equalization", "value", list(N.REGIMES)), "best")


E13 = f"WITH {RUNS} SELECT method, " + ", ".join(f"max(value) FILTER (equalization = '{x}') AS {x}" for x in N.REGIMES) + ", round(max(value), 6) AS best FROM runs GROUP BY method"


def d37(spark, d):
    docs = table(spark, d, "documents").withColumn("selection", F.col("doc_id") % 100)
    return R.common_tags(docs, "lang", "source", "selection")


D37 = """SELECT doc_id % 100 AS selection, CASE WHEN min(lang) = max(lang) THEN min(lang) END AS lang, CASE WHEN min(source) = max(source) THEN min(source) END AS source,
  coalesce(min(lang) <> max(lang), false) OR coalesce(min(source) <> max(source), false) AS is_mixed FROM documents GROUP BY ALL"""


def d35(spark, d):
    return rounded(R.timing_table(runs(spark, d).withColumn("ms", F.col("value") * 10), "method", "ms"), "mean_ms", "median_ms", "std_ms")


def d36(spark, d):
    rows = runs(spark, d).withColumn("kind", F.concat(F.lit("kind"), F.col("user_id") % 3))
    return R.coverage_matrix(rows, ["method", "equalization"], "kind", ["kind0", "kind1", "kind2"], 150)


D36 = f"""WITH {RUNS} SELECT method, equalization, count(*) FILTER (user_id % 3 = 0) AS kind0, count(*) FILTER (user_id % 3 = 1) AS kind1, count(*) FILTER (user_id % 3 = 2) AS kind2,
  least(count(*) FILTER (user_id % 3 = 0), count(*) FILTER (user_id % 3 = 1), count(*) FILTER (user_id % 3 = 2)) < 150 AS incomplete FROM runs GROUP BY method, equalization"""


_TAGS = [*R.IN_DOMAIN, *R.CROSS]


def tagged(spark, d):
    """Events as validations: some methods have no corrected ones, some settings no original ones."""
    e, k = runs(spark, d), F.col("run_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    rows = e.select(
        pick(["kaist", "llvip"], k % 2).alias("model_dataset"), "equalization", pick(["kaist_80_20", "llvip_80_20"], F.floor(k / 2) % 2).alias("test_dataset"),
        pick(["day", "night"], F.floor(k / 4) % 2).alias("condition"), F.col("method").alias("fusion"), pick(_TAGS, F.floor(k / 8) % 5).alias("tag"),
    )
    return rows.filter(((F.col("tag") != "npzfix") | (F.length("fusion") % 2 == 0)) & ((F.col("tag") != "train") | (F.col("equalization") != "rgb_equalization")) & ((F.length("fusion") != 5) | (F.col("condition") == "day")))


TAGGED = f"""{RUNS}, tagged AS (SELECT * FROM (SELECT ['kaist', 'llvip'][1 + run_id % 2] AS model_dataset, equalization, ['kaist_80_20', 'llvip_80_20'][1 + (run_id // 2) % 2] AS test_dataset,
  ['day', 'night'][1 + (run_id // 4) % 2] AS condition, method AS fusion, [{", ".join(f"'{x}'" for x in _TAGS)}][1 + (run_id // 8) % 5] AS tag FROM runs)
  WHERE (tag <> 'npzfix' OR length(fusion) % 2 = 0) AND (tag <> 'train' OR equalization <> 'rgb_equalization') AND (length(fusion) <> 5 OR condition = 'day')),
counted AS (SELECT model_dataset, equalization, test_dataset, condition, fusion, {", ".join(f"count(*) FILTER (tag = '{x}') AS {x}" for x in _TAGS)} FROM tagged GROUP BY ALL),
cells AS (SELECT model_dataset, equalization, test_dataset, condition, fusion, CASE WHEN starts_with(test_dataset, model_dataset) THEN 'in_domain' ELSE 'cross' END AS kind,
  CASE WHEN NOT starts_with(test_dataset, model_dataset) THEN cross_kaist + cross_llvip WHEN npzfix > 0 THEN npzfix WHEN train > 0 THEN train ELSE val END AS "count" FROM counted)"""


def d36_cells(spark, d):
    return R.coverage_cells(tagged(spark, d))


def d36_long(spark, d):
    return R.coverage_long(tagged(spark, d), 20)


D36_LONG = f"""WITH {TAGGED}, settings AS (SELECT DISTINCT model_dataset, equalization, test_dataset, condition, kind FROM cells), methods AS (SELECT DISTINCT fusion FROM cells)
SELECT s.*, m.fusion, coalesce(c."count", 0) AS "count", coalesce(c."count", 0) BETWEEN 1 AND 19 AS few FROM settings s CROSS JOIN methods m LEFT JOIN cells c USING (model_dataset, equalization, test_dataset, condition, kind, fusion)"""


def c1(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", F.create_map(F.lit("pr_data_1"), F.col("o_totalprice"), F.lit("validation_1"), F.col("o_totalprice") / 2, F.lit("other"), F.lit(1.0)).alias("blocks"))
    override = table(spark, d, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.max("l_tax").alias("tax"))
    override = override.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("tax") > 0.04, F.create_map(F.lit("pr_data_9"), "tax", F.lit("validation_9"), "tax")).otherwise(F.create_map(F.lit("pr_data_9"), "tax")).alias("blocks"))
    out = R.overlay_validation(base, override, "o_orderkey", "blocks")
    return out.select("o_orderkey", "overridden", F.array_join(F.array_sort(F.map_keys("blocks")), ",").alias("names"))


C1 = """WITH o AS (SELECT l_orderkey, max(l_tax) > 0.04 AS full_one FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(full_one, false) AS overridden, CASE WHEN full_one THEN 'other,pr_data_9,validation_9' ELSE 'other,pr_data_1,validation_1' END AS names FROM orders LEFT JOIN o ON o_orderkey = l_orderkey"""


def a3(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("pr_epoch"), (F.col("o_orderkey") % 7).alias("val_epoch"), F.lit(2).alias("epoch_best_fit_index"), F.expr("map_from_entries(transform(filter(array(0, 1, 2, 3), x -> x <> o_custkey % 4), x -> struct(concat('pr_data_', x), o_totalprice + x)))").alias("p"), F.expr("map_from_entries(transform(array(0, 1, 2), x -> struct(concat('validation_', x), o_totalprice - x)))").alias("v"))
    got = R.resolve_best(o.withColumn("blocks", F.map_concat("p", "v")))
    return rounded(got.select("o_orderkey", "pr_best", "validation_best"), "pr_best", "validation_best", digits=3)


A3 = """WITH o AS (SELECT o_orderkey, o_totalprice AS v, o_orderkey % 5 - 1 AS p, o_orderkey % 7 - 1 AS q, o_custkey % 4 AS gone FROM orders),
f AS (SELECT *, p BETWEEN 0 AND 3 AND p <> gone AND q BETWEEN 0 AND 2 AS has_last, gone <> 2 AS has_best FROM o)
SELECT o_orderkey, round(CASE WHEN has_last THEN v + p ELSE v + 2 END, 3) AS pr_best, round(CASE WHEN has_last THEN v - q ELSE v - 2 END, 3) AS validation_best FROM f WHERE has_last OR has_best"""


def d5(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.create_map(F.lit("person"), F.struct(F.col("p_retailprice").alias("P"), F.col("p_size").alias("R")), F.lit("all"), F.struct(F.lit(0.0).alias("P"), F.lit(0).alias("R")), F.lit("cyclist"), F.struct((F.col("p_retailprice") / 2).alias("P"), (F.col("p_size") + 1).alias("R"))).alias("metrics"))
    return R.run_table(rows)


D5 = "SELECT p_partkey, unnest(['person', 'cyclist']) AS class, unnest([p_retailprice, p_retailprice / 2]) AS P, unnest([p_size, p_size + 1]) AS R FROM part"

PLANS = {
    "d7_cells": (d7, f"WITH {RUNS}, {CELLS} SELECT method, equalization, n, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(best, 6) AS best, round(p90, 6) AS p90 FROM cells"),
    "d8_regime_means": (d8_means, f"WITH {RUNS}, {CELLS} SELECT equalization, round(avg(mean), 6) AS mean, count(mean) AS methods FROM cells GROUP BY 1"),
    "d8_pivot": (d8, f"WITH {RUNS}, {CELLS} SELECT method, " + ", ".join(f"round(max(mean) FILTER (equalization = '{x}'), 6) AS {x}" for x in N.REGIMES) + " FROM cells GROUP BY method"),
    "d9_delta_vs_baseline": (d9, f"""WITH {RUNS}, {CELLS}, b AS (SELECT method, sqrt(avg(CASE WHEN n > 1 THEN std * std END)) AS noise, max(CASE WHEN equalization = 'no_equalization' THEN mean END) AS base FROM cells GROUP BY method)
  SELECT method, equalization, round(mean, 6) AS value, round(base, 6) AS base, round(mean - base, 6) AS delta, round(noise, 6) AS noise FROM cells JOIN b USING (method) WHERE equalization <> 'no_equalization' AND base IS NOT NULL"""),
    "d10_keep_covered": (d10, f"WITH {PART_RUNS} SELECT method, count(*) AS n FROM runs GROUP BY method HAVING count(DISTINCT equalization) >= 4"),
    "d6_averaged_table": (d6, f"WITH {PART_RUNS} SELECT method, equalization, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std FROM runs GROUP BY ALL"),
    "d1_summary": (d1, D1), "d2_map_summary": (d2, D2), "d3_mode_counts": (d3, D3), "d5_run_table": (d5, D5),
    "d19_normal_percentile": (d19, D19), "d20_curve_percentile": (d20, D20), "d21_percentile_record": (d21, D21),
    "d22_curve_envelope": (d22, f"WITH {CURVES} SELECT label, pt, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, count(value) AS n, round(avg(vec_id / 10), 6) AS mean_duration FROM curves GROUP BY ALL"),
    "d23_metric_density": (d23, D23), "d23_normal_curve": (d23_normal, D23_NORMAL), "d24_lamr": (d24, D24), "d25_lamr_step": (d25, D25), "d26_miss_rate": (d26, D26),
    "d35_timing": (d35, f"WITH {RUNS} SELECT method, round(avg(value * 10), 6) AS mean_ms, round(median(value * 10), 6) AS median_ms, round(stddev_samp(value * 10), 6) AS std_ms, count(value) AS n FROM runs GROUP BY method"),
    "d36_coverage": (d36, D36), "d36_priority": (d36_cells, f"WITH {TAGGED} SELECT * FROM cells"), "d36_long": (d36_long, D36_LONG),
    "d37_common_tags": (d37, D37),
    "e1_best_trials": (e1, f"WITH {RUNS}, k AS (SELECT method || '/' || equalization AS cell, run_id, value, row_number() OVER (PARTITION BY method, equalization ORDER BY value DESC NULLS LAST, run_id) AS k FROM runs) SELECT cell, run_id, value FROM k WHERE k = 1"),
    "e2_top_k": (e2, f"WITH {RUNS}, k AS (SELECT equalization, method, run_id, value, row_number() OVER (PARTITION BY equalization ORDER BY value DESC, run_id)::INT AS rank FROM runs) SELECT * FROM k WHERE rank <= 10"),
    "e3_dedup_first": (e3, "SELECT sha256(text) AS name, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1"),
    "e12_boundaries": (e12, E12), "e13_order_labels": (e13, E13), "c1_overlay": (c1, C1), "a3_resolve_best": (a3, A3),
}
