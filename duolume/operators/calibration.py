"""Calibration of scores on mixtures of known share, and the weighted latent share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duolume.sources.archives import combine_variants

from .incremental import KEY, KeyedStore, cache_key
from .pixels import ALL, fuse_all, haar, inverse_haar
from .quantiles import aggregate_with_medians
from .scores import GROUP, MOST_WEIGHT, PROXIES, aggregate_proxies, cap_weights, channel_redundancy, proxies, score_table
from .stats import interp_column
from .stored import stored
from .tables import recalibrate_means

FLOOR = 0.01
#: Fixed value: preference among kinds of samples that fit as well.
KINDS = ("blend", "freq_blend", "nonlinear", "concat")


#: What stands in the three channels of a substitution: its own visible one (v), the thermal one (t), or half of each (m).
PATTERNS = ("vvv", "vvt", "vtv", "tvv", "vtt", "tvt", "ttv", "ttt", "vvm", "vmv", "mvv", "vmt", "mvt", "mtv", "mtt", "tmt", "ttm")
_SHARES = {"v": 0.0, "m": 0.5, "t": 1.0}
_EPS = 1e-8


def freq_blend(px: DataFrame, alphas: list[float]) -> DataFrame:
    """Mixtures in the Haar domain: blended approximations, and the details that are larger when weighed by alpha. All alphas are columns of one pass."""
    bands, picks = haar(px, list(ALL)), {}
    for k, a in enumerate(alphas):
        for c in "bgr":
            picks[f"{c}{k}_a"] = (1 - a) * F.col(f"{c}_a") + a * F.col("t_a")
            picks |= {f"{c}{k}_{d}": F.when(F.abs(f"t_{d}") * a > F.abs(f"{c}_{d}") * (1 - a), F.col(f"t_{d}")).otherwise(F.col(f"{c}_{d}")) for d in "hvd"}
    back = inverse_haar(bands.withColumns(picks), [f"{c}{k}" for k in range(len(alphas)) for c in "bgr"])
    clipped = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c)))
    each = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit("freq_blend").alias("stype"), *[clipped(f"{c}{k}").alias(f"f{i}") for i, c in enumerate("bgr")]) for k, a in enumerate(alphas)])
    return back.select("image_id", "y", "x", F.explode(each).alias("m")).select("image_id", "y", "x", "m.*")


def synth_mixtures(px: DataFrame, alphas: list[float]) -> DataFrame:
    """Mixtures of known thermal share alpha: blends, geometric blends (on 0..1) and Haar blends, and channel substitutions (with their pattern) with the share they imply."""
    grid = px.select("*", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    b = lambda c: (1 - F.col("alpha")) * F.col(c) + F.col("alpha") * F.col("t")
    n = lambda c: 255 * F.least(F.lit(1.0), F.pow(F.col(c) / 255 + _EPS, 1 - F.col("alpha")) * F.pow(F.col("t") / 255 + _EPS, F.col("alpha")))
    kinds = grid.select("image_id", "y", "x", "alpha", F.explode(F.array(*[F.struct(F.lit(k).alias("stype"), *[f(c).alias(f"f{i}") for i, c in enumerate("bgr")]) for k, f in (("blend", b), ("nonlinear", n))])).alias("m")).select("image_id", "y", "x", "alpha", "m.*")
    put = {"v": F.col, "t": lambda c: F.col("t"), "m": lambda c: (F.col(c) + F.col("t")) / 2}
    swaps = [F.struct(F.lit(sum(map(_SHARES.get, p)) / 3).alias("alpha"), F.lit("concat").alias("stype"), F.lit(p).alias("pattern"), *[put[k](c).cast("double").alias(f"f{i}") for i, (k, c) in enumerate(zip(p, "bgr", strict=True))]) for p in PATTERNS]
    swapped = px.select("image_id", "y", "x", F.explode(F.array(*swaps)).alias("m")).select("image_id", "y", "x", "m.*")
    out = kinds.unionByName(freq_blend(px, alphas)).withColumn("pattern", F.lit(""))
    return out.unionByName(swapped.select(out.columns))


def has_value(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def isotonic_knots(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Non-decreasing knots of the visible share 1 - alpha over the median raw score of each alpha.

    The pool-adjacent-violators result at knot i is the largest over j <= i of the smallest over k >= i
    of the mean from j to k; knots are few (one for each alpha).
    """
    mid = aggregate_with_medians(samples, [*keys, "alpha"], ["raw"], [F.count("*").alias("__n")]).select(*keys, "alpha", F.col("raw_median").alias("knot_x"))
    w = Window.partitionBy(*keys).orderBy("knot_x", F.desc("alpha"))
    k = mid.withColumn("i", F.row_number().over(w)).withColumn("v", 1 - F.col("alpha"))
    run = k.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a, c = run.select(*keys, F.col("i").alias("j"), (F.col("s") - F.col("v")).alias("s0")), run.select(*keys, F.col("i").alias("k"), F.col("s").alias("s1"))
    means = a.join(c, keys).filter("k >= j").withColumn("m", (F.col("s1") - F.col("s0")) / (F.col("k") - F.col("j") + 1))
    low = k.select(*keys, "i", "knot_x").join(means, keys).filter("j <= i and k >= i").groupBy(*keys, "i", "knot_x", "j").agg(F.min("m").alias("m"))
    return low.groupBy(*keys, "i", "knot_x").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("m"))).alias("knot_y"))


def packed_knots(knots: DataFrame, keys: list[str]) -> DataFrame:
    return knots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("knot_x", "knot_y"))).alias("knots"))


#: The robust mean of a sample's proxies, as a proxy of its own: its curve stands in where none of a row's proxies has one.
AGGREGATE = "aggregate"


def with_aggregate(samples: DataFrame, sample: list[str]) -> DataFrame:
    """Adds the robust mean of each sample's proxies (rows of equal `sample` columns, among them stype and alpha) as proxy AGGREGATE."""
    robust = aggregate_proxies(samples, sample, "raw").select(*sample, F.lit(AGGREGATE).alias("proxy"), F.col("robust").alias("raw"))
    return samples.select(*sample, "proxy", "raw").unionByName(robust)


def calibration_sigmas(samples: DataFrame, knots: DataFrame) -> DataFrame:
    """stype, proxy, alpha, sigma: deviation of the calibrated share at each alpha."""
    keys = ["stype", "proxy"]
    seen = samples.join(knots, keys).withColumn("cal", interp_column(F.col("knots"), F.col("raw")))
    return seen.groupBy(*keys, "alpha").agg(F.stddev_pop("cal").alias("sigma"))


def fit_calibration(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """samples (stype, proxy, alpha, raw) -> knots by (stype, proxy), and weights by (stype, proxy).

    A proxy's weight is the inverse of its mean calibrated deviation over alpha (0.01 at least). AGGREGATE has knots and no weight.
    """
    keys = ["stype", "proxy"]
    knots = packed_knots(isotonic_knots(samples, keys), keys)
    sigma = calibration_sigmas(samples.filter(F.col("proxy") != AGGREGATE), knots)
    weights = sigma.groupBy(*keys).agg((1 / F.greatest(F.avg("sigma"), F.lit(FLOOR))).alias("w"), F.array_sort(F.collect_list(F.struct(F.col("alpha").alias("knot_x"), F.greatest(F.col("sigma"), F.lit(FLOOR)).alias("knot_y")))).alias("sigmas"))
    whole = F.sum("w").over(Window.partitionBy("stype"))
    return knots, weights.withColumn("w", F.col("w") / whole)


def average_weights(weights: DataFrame) -> DataFrame:
    """Weights over kinds of samples; a proxy that a kind lacks counts as 0 there."""
    kinds = weights.select("stype").distinct().agg(F.count("*").alias("kinds"))
    mean = weights.groupBy("proxy").agg(F.sum("w").alias("w")).join(F.broadcast(kinds)).withColumn("w", F.col("w") / F.col("kinds"))
    return mean.select("proxy", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("w"))


def calibrated(values: DataFrame, knots: DataFrame) -> DataFrame:
    """values (keys..., proxy, value) with each kind's calibrated visible share."""
    return values.join(knots, "proxy").withColumn("cal", interp_column(F.col("knots"), F.col("value"))).drop("knots")


def select_calibration(cal: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """The kind of samples under which a row's proxies agree best (least weighted deviation)."""
    rows = cal.join(weights.select("stype", "proxy", "w"), ["stype", "proxy"])
    mean = rows.groupBy(*keys, "stype").agg((F.sum(F.col("w") * F.col("cal")) / F.sum("w")).alias("mean"), (F.sum(F.col("w") * F.col("cal") * F.col("cal")) / F.sum("w")).alias("square"))
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("stype")), F.lit(0)), F.lit(len(KINDS) + 1))
    spread = F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))), 12)
    best = mean.groupBy(*keys).agg(F.min(F.struct(spread.alias("spread"), order.alias("place"), "stype")).alias("m"))
    return best.select(*keys, F.col("m.stype").alias("stype"), F.col("m.spread").alias("spread"))


def apply_calibration(cal: DataFrame, chosen: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """latent_z: 1 - the weighted visible share, with capped global weights."""
    rows = cal.join(chosen.select(*keys, "stype"), [*keys, "stype"]).join(weights, "proxy")
    packed = rows.groupBy(*keys, "stype").agg(F.array_sort(F.collect_list(F.struct("proxy", "cal", "w"))).alias("p"))
    packed = packed.withColumn("cw", cap_weights(F.transform("p", lambda x: x["w"])))
    share = F.aggregate(F.zip_with("p", "cw", lambda a, b: a["cal"] * b), F.lit(0.0), lambda s, x: s + x)
    return packed.select(*keys, "stype", (1 - share).alias("latent_z"), "cw")


def latent_share(values: DataFrame, raw: DataFrame, knots: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """latent_z of every row of `raw` (keys, raw): by its proxies (values: keys, proxy, value), or by the aggregate curve where none of them is calibrated.

    The aggregate curve is that of the first kind of samples by preference; a finite raw score is all it needs.
    """
    own = knots.filter(F.col("proxy") != AGGREGATE)
    cal = calibrated(values.filter(has_value("value")), own)
    chosen = select_calibration(cal, weights, keys)
    by_proxies = apply_calibration(cal, chosen, average_weights(weights), keys).select(*keys, "stype", "latent_z")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("stype")), F.lit(0)), F.lit(len(KINDS) + 1))
    curve = knots.filter(F.col("proxy") == AGGREGATE).agg(F.min_by(F.struct("stype", "knots"), F.struct(place, "stype")).alias("c")).select(F.col("c.stype").alias("__stype"), F.col("c.knots").alias("__knots"))
    # a single row, with a knot for each alpha
    rows = raw.join(by_proxies, keys, "left").crossJoin(F.broadcast(curve))
    by_aggregate = 1 - interp_column(F.col("__knots"), F.col("raw"))
    return rows.select(*keys, F.coalesce("stype", "__stype").alias("stype"), F.coalesce("latent_z", by_aggregate).alias("latent_z"), F.col("latent_z").isNull().alias("by_aggregate"))


def sigma_at_latent(methods: DataFrame, sigmas: DataFrame, stype: str = KINDS[0]) -> DataFrame:
    """methods (method, proxy, latent_z, sigma) with the calibration's deviation for the proxy: its mean over alpha, and at the method's latent share (linear, flat at the ends)."""
    curve = sigmas.filter(F.col("stype") == stype).groupBy("proxy").agg(F.array_sort(F.collect_list(F.struct(F.col("alpha").alias("knot_x"), F.col("sigma").alias("knot_y")))).alias("__k"), F.avg("sigma").alias("sigma_calibration_global"))
    at = interp_column(F.col("__k"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("latent_z"))))
    return methods.join(curve, "proxy", "left").select("method", "proxy", "latent_z", F.col("sigma").alias("sigma_empirical"), "sigma_calibration_global", F.when(~F.isnan("latent_z"), at).alias("sigma_calibration_at_latent_z"))


def apply_alpha_dep(cal: DataFrame, chosen: DataFrame, sigmas: DataFrame, keys: list[str], rounds: int = 4, tolerance: float = 1e-3) -> DataFrame:
    """Weights that depend on the share itself: up to four rounds of w = 1 / sigma at the last estimate, capped."""
    rows = cal.join(chosen.select(*keys, "stype"), [*keys, "stype"]).join(sigmas.select("stype", "proxy", "sigmas"), ["stype", "proxy"])
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("proxy", "cal", "sigmas"))).alias("p"))
    first = F.struct(F.array(1 - F.aggregate("p", F.lit(0.0), lambda s, x: s + x["cal"]) / F.size("p")).alias("trace"), F.lit(0).alias("iterations"), F.lit(False).alias("converged"))

    def step(state: Column) -> Column:
        last = F.element_at(state["trace"], -1)
        w = cap_weights(F.transform("p", lambda x: 1 / interp_column(x["sigmas"], last)), MOST_WEIGHT)
        now = 1 - F.aggregate(F.zip_with("p", w, lambda a, b: a["cal"] * b), F.lit(0.0), lambda s, x: s + x)
        entered = F.transform(F.array(now), lambda n: F.struct(F.concat(state["trace"], F.array(n)).alias("trace"), (state["iterations"] + 1).alias("iterations"), F.coalesce(F.abs(n - last) < tolerance, F.lit(False)).alias("converged")))
        return F.get(entered, 0)

    # one loop over the rounds: the plan is as small for four as for one
    state = F.aggregate(F.array_repeat(F.lit(0), rounds), first, lambda s, _: F.when(s["converged"], s).otherwise(step(s)))
    return packed.select(*keys, state.alias("__s")).select(*keys, F.element_at("__s.trace", -1).alias("latent_z_alpha_dep"), *[F.col(f"__s.{c}").alias(c) for c in ("trace", "iterations", "converged")])


def calibration_nodes(samples: DataFrame, keys: list[str], knots: DataFrame | None = None) -> DataFrame:
    """Per alpha: n, median and deviation of the raw score, and the ideal; with knots (by the keys) the latent share at the median too."""
    others = [F.count("*").alias("n"), F.stddev_pop("raw").alias("sigma"), (100 * (1 - F.first("alpha"))).alias("ideal")]
    nodes = aggregate_with_medians(samples, [*keys, "alpha"], ["raw"], others).withColumnRenamed("raw_median", "median")
    if knots is None:
        return nodes
    return nodes.join(knots, keys, "left").withColumn("latent_z", 1 - interp_column(F.col("knots"), F.col("median"))).drop("knots")


def weight_shift(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two weight tables side by side and the change in percent."""
    both = a.select(key, F.col("w").alias("w_a")).join(b.select(key, F.col("w").alias("w_b")), key, "full")
    return both.withColumn("shift", F.when(F.col("w_a") > 0, 100 * (F.col("w_b") - F.col("w_a")) / F.col("w_a")))


def methods_overview(scored: DataFrame, method: str, columns: list[str]) -> DataFrame:
    """Mean, deviation and median of each column by method, thermal share, lift of calibration; the most thermal first."""
    out = scored.groupBy(method).agg(*[f(c).alias(f"{c}_{s}") for c in columns for s, f in (("mean", F.avg), ("std", F.stddev_pop), ("median", F.median))], F.count("*").alias("n"))
    if "reg" in columns and "latent_z" in columns:
        out = out.withColumn("thermal_share_reg", 1 - F.col("reg_mean") / 100).withColumn("calibration_lift", F.col("latent_z_mean") - (1 - F.col("reg_mean") / 100))
    return out.orderBy(F.col(f"{columns[-1]}_mean").desc(), method)


def calibrate(px: DataFrame, alphas: list[float], names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Knots and weights from the mixtures of a set of images. Both are stored (one row for each kind of mixture and proxy), and so are the mixtures' scores, once for all proxies.

    A proxy without a value (of an image that lacks a channel) is no sample.
    """
    # several substitutions share an alpha, so the pattern belongs to a mixture's name
    label = F.concat_ws("|", "stype", F.col("alpha").cast("string"), "pattern")
    fused = synth_mixtures(px, alphas).select(label.alias("method"), "image_id", "y", "x", F.array("f0", "f1", "f2").alias("c"))
    raw = proxies(stored(score_table(px, fused), "mixtures"), names, average_orders=True)
    field = lambda i: F.split_part("method", F.lit("|"), F.lit(i))
    rows = raw.select(field(1).alias("stype"), "proxy", field(2).cast("double").alias("alpha"), F.col("value").alias("raw"), "method", "image_id")
    samples = stored(with_aggregate(rows, ["stype", "alpha", "method", "image_id"]).filter(has_value("raw")), "samples")
    knots, weights = fit_calibration(samples)
    return stored(knots, "knots"), stored(weights, "weights")


def evaluate(px: DataFrame, fused: DataFrame, knots: DataFrame, weights: DataFrame, names: list[str] | None = None) -> DataFrame:
    """End to end: every method and image with its proxies, their robust mean, redundancy of channels, and latent shares.

    The score table is stored, so that fusions run once and not once for each proxy; so are the
    proxies (one row for each method, image and proxy), which several joins read. A proxy without
    a value (of an image that lacks a channel) has no part in the shares; without any, they are null.
    """
    names = names or list(PROXIES)
    s = stored(score_table(px, fused), "scores")
    values = stored(proxies(s, names, average_orders=True), "proxies")
    cal = calibrated(values.filter(has_value("value")), knots)
    chosen = select_calibration(cal, weights, GROUP)
    latent = apply_calibration(cal, chosen, average_weights(weights), GROUP)
    dep = apply_alpha_dep(cal, chosen, weights, GROUP)
    wide = values.groupBy(*GROUP).pivot("proxy", names).agg(F.first("value"))
    robust = aggregate_proxies(values, GROUP).drop("mean", "std")
    parts = [wide, robust, channel_redundancy(s).select(*GROUP, "redundancy"), latent.drop("cw"), dep.drop("trace")]
    return reduce(lambda a, b: a.join(b, GROUP, "left"), parts)


def mean_overview(scored: DataFrame, knots: DataFrame, columns: list[str]) -> DataFrame:
    """The methods' overview, with the latent share of the mean beside the mean of the latent shares.

    The aggregate curve isn't a line, so that means of latent shares can rank methods of
    unlike spread the wrong way; latent_z_of_mean maps the mean robust score instead, and
    the calibrated percentages follow from it.
    """
    out = methods_overview(scored, "method", columns).withColumn("__a", F.lit(AGGREGATE)).withColumn("__k", F.lit(KINDS[0]))
    curve = knots.filter((F.col("proxy") == AGGREGATE) & (F.col("stype") == KINDS[0])).select(F.col("proxy").alias("__a"), F.col("knots").alias("__knots"))
    out = recalibrate_means(out.join(curve, "__a", "left"), F.col("__knots"), "robust_mean", "latent_z_of_mean").drop("__a", "__k", "__knots")
    return out.withColumns({"cont_lw_calibrated": 100 * F.col("latent_z_of_mean"), "cont_vis_calibrated": 100 - 100 * F.col("latent_z_of_mean")})


def evaluate_variants(px: DataFrame, parts: DataFrame, methods: list[str], variants: dict[str, tuple[str, str, Callable[[DataFrame], DataFrame]]], alphas: list[float], names: list[str] | None = None) -> DataFrame:
    """End to end under several equalisations: variant, eq_vis, eq_th and the overview of all methods.

    A variant is its two equalisations' names and what makes its pixels. Each is
    calibrated on its own images of the calibration part (parts: image_id, part) and
    evaluated on those of the evaluation part; pixels of a variant are stored once.
    """
    out = {}
    for variant, (eq_vis, eq_th, change) in variants.items():
        own = stored(change(px), f"variant-{variant}")
        of = lambda part, own=own: own.join(parts.filter(F.col("part") == part).select("image_id"), "image_id")
        knots, weights = calibrate(of("calibration"), alphas, names)
        seen = of("evaluation")
        scored = stored(evaluate(seen, fuse_all(seen, methods), knots, weights, names), "evaluated")
        out[variant] = (eq_vis, eq_th, mean_overview(scored, knots, [*(names or list(PROXIES)), "robust", "redundancy", "latent_z_alpha_dep", "latent_z"]))
    return combine_variants(out)


#: Changes when scores of the same pixels would.
SCORES_VERSION = "1"


def wanted_scores(images: DataFrame, methods: dict[str, str], equalization: str) -> DataFrame:
    """cache_key, method, image_id of each method (with its fingerprint) and image (image_id, visible_time, thermal_time)."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(f).alias("mark")) for m, f in methods.items()]))
    key = cache_key(SCORES_VERSION, F.col("m.method"), F.col("m.mark"), equalization, F.col("image_id"), F.col("visible_time"), F.col("thermal_time"))
    return images.select("image_id", "visible_time", "thermal_time", each.alias("m")).select(key.alias(KEY), "m.method", "image_id")


def score_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, "method string, image_id long, proxy string, value double")


def incremental_scores(store: KeyedStore, px: DataFrame, wanted: DataFrame, names: list[str] | None = None, average_orders: bool = True) -> DataFrame:
    """Proxies (method, image_id, proxy, value) of all wanted pairs; only pairs that aren't stored are fused and scored, and these are stored.

    Calibration isn't stored: it is applied to what this returns.
    """

    def compute(missing: DataFrame) -> DataFrame:
        missing = stored(missing, "missing")
        methods = [x[0] for x in missing.select("method").distinct().orderBy("method").collect()]
        each = [fuse_all(px.join(missing.filter(F.col("method") == m).select("image_id"), "image_id"), [m]) for m in methods]
        scores = stored(score_table(px, reduce(DataFrame.unionByName, each)), "scores")
        return proxies(scores, names, average_orders).join(missing, ["method", "image_id"])

    return store.complete(wanted, compute)


def evaluate_incremental(store: KeyedStore, px: DataFrame, wanted: DataFrame, knots: DataFrame, weights: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Latent share of every wanted method and image, from stored proxies where there are any."""
    values = incremental_scores(store, px, wanted, names).select(*GROUP, "proxy", "value")
    raw = aggregate_proxies(values, GROUP).select(*GROUP, F.col("robust").alias("raw"))
    return latent_share(values, raw, knots, weights, GROUP)
