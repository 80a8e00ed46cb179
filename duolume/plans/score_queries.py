"""Contribution scores of fused images, and their calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolume.operators import calibration as C
from duolume.operators import pixels as P
from duolume.operators import scores as S
from duolume.operators.sampling import split_calibration
from duolume.operators.stored import stored

from .run_queries import rounded
from .views import PIXELS, pixels, placed, table

METHODS = ["rgbt", "rgbt_v2", "visible", "lwir"]


def scored(spark, d, methods=METHODS):
    px = placed(pixels(spark, d))
    return S.score_table(px, P.fuse_all(px, methods))


def proxy(name):
    return lambda spark, d: rounded(S.PROXIES[name](scored(spark, d)), "value", digits=5)


FUSED = PIXELS + """, fu AS (SELECT 'visible' AS method, image_id, y, x, b AS v0, g AS v1, r AS v2, t, b AS f0, g AS f1, r AS f2 FROM px UNION ALL SELECT 'lwir', image_id, y, x, b, g, r, t, t, t, t FROM px
  UNION ALL SELECT 'rgbt', image_id, y, x, b, g, r, t, floor(255 * (b + t) / 510), floor(255 * (g + t) / 510), floor(255 * (r + t) / 510) FROM px UNION ALL SELECT 'rgbt_v2', image_id, y, x, b, g, r, t, floor(255 * (b * t) / 65025), floor(255 * (g * t) / 65025), floor(255 * (r * t) / 65025) FROM px),
en AS (SELECT method, image_id, """ + ", ".join(f"min({c}) AS l_{c}, max({c}) AS h_{c}" for c in S.CHANNELS) + " FROM fu GROUP BY ALL), sc AS (SELECT fu.method, fu.image_id, y, x, " + ", ".join(f"CASE WHEN h_{c} - l_{c} < 1e-12 THEN 0.5 ELSE ({c} - l_{c}) / (h_{c} - l_{c}) END AS {c}" for c in S.CHANNELS) + " FROM fu JOIN en USING (method, image_id))"

REG = f"""WITH {FUSED}, m AS (SELECT method, image_id, ch, sum(v * v) AS vv, sum(t * t) AS tt, sum(v * t) AS vt, sum(v * f) AS vf, sum(t * f) AS tf FROM (SELECT method, image_id, t, unnest([0, 1, 2]) AS ch, unnest([v0, v1, v2]) AS v, unnest([f0, f1, f2]) AS f FROM sc) GROUP BY ALL),
d AS (SELECT *, vv * tt - vt * vt AS det, greatest(0, vf / vv) AS pa, greatest(0, tf / tt) AS pb FROM m), e AS (SELECT *, (vf * tt - tf * vt) / det AS a0, (tf * vv - vf * vt) / det AS b0 FROM d),
s AS (SELECT *, CASE WHEN det > 1e-12 AND a0 >= 0 AND b0 >= 0 THEN a0 WHEN pa * vf >= pb * tf THEN pa ELSE 0 END AS a, CASE WHEN det > 1e-12 AND a0 >= 0 AND b0 >= 0 THEN b0 WHEN pa * vf >= pb * tf THEN 0 ELSE pb END AS b FROM e)
SELECT method, image_id, round(avg(CASE WHEN a + b < 1e-8 THEN 50 ELSE 100 * a / (a + b) END), 5) AS value FROM s GROUP BY ALL"""


def c0(a, b):
    return f"CASE WHEN stddev_pop({a}) < 1e-12 OR stddev_pop({b}) < 1e-12 THEN 0 ELSE corr({a}, {b}) END"


SPECTRAL = f"""WITH {FUSED}, m AS (SELECT method, image_id, {", ".join(f"{c0(f'{k}{i}', f'{k}{j}')} AS {k}{i}{j}" for k in "fv" for i, j in ((0, 1), (0, 2), (1, 2)))} FROM sc GROUP BY ALL),
d AS (SELECT *, sqrt(2 * (pow(f01 - v01, 2) + pow(f02 - v02, 2) + pow(f12 - v12, 2))) AS dv, sqrt(2 * (pow(f01 - 1, 2) + pow(f02 - 1, 2) + pow(f12 - 1, 2))) AS dt FROM m)
SELECT method, image_id, round(CASE WHEN dv + dt < 1e-8 THEN 50 ELSE 100 * dt / (dv + dt) END, 5) AS value FROM d"""


# ---- SQL of the scores by neighbourhoods, histograms and spectra; an image is 8 x 8


def pairs_sql(rows, keys):
    """`pr`: a row for each pixel, channel and source: the fused value and the source's."""
    return f"pr AS (SELECT {keys}, y, x, unnest([0, 0, 1, 1, 2, 2]) AS ch, unnest(['v', 't', 'v', 't', 'v', 't']) AS source, unnest([f0, f0, f1, f1, f2, f2]) AS f, unnest([v0, t, v1, t, v2, t]) AS o FROM {rows})"


def mi_sql(keys):
    """`mi`: mutual information of each channel and source of `pr`, over 128 x 128 bins."""
    group = f"{keys}, ch, source"
    return f"""ce AS (SELECT {group}, least(floor(f * 128), 127) AS i, least(floor(o * 128), 127) AS j, count(*) / 64 AS p FROM pr GROUP BY ALL),
ma AS (SELECT *, sum(p) OVER (PARTITION BY {group}, i) + 128e-10 AS pi, sum(p) OVER (PARTITION BY {group}, j) + 128e-10 AS pj FROM ce),
mi AS (SELECT {group}, greatest(0, sum((p + 1e-10) / (1 + 16384e-10) * ln((p + 1e-10) * (1 + 16384e-10) / (pi * pj)))) AS mi FROM ma GROUP BY ALL)"""


def ssim_sql(keys):
    """`si`: mean similarity of `pr` to either source over the pixels with a whole 7 x 7 window, by sample variances."""
    return f"""cn AS (SELECT {keys}, ch, source, y AS cy, x AS cx FROM pr WHERE y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4),
st AS (SELECT {keys}, source, avg(f) AS mf, avg(o) AS mo, greatest(0, avg(f * f) - avg(f) * avg(f)) + greatest(0, avg(o * o) - avg(o) * avg(o)) AS va, avg(f * o) - avg(f) * avg(o) AS co FROM cn JOIN pr USING ({keys}, ch, source) WHERE abs(y - cy) <= 3 AND abs(x - cx) <= 3 GROUP BY {keys}, ch, source, cy, cx),
sm AS (SELECT {keys}, source, (2 * mf * mo + 1e-4) * (2 * 49 / 48 * co + 9e-4) / ((mf * mf + mo * mo + 1e-4) * (49 / 48 * va + 9e-4)) AS s FROM st),
si AS (SELECT {keys}, avg(CASE source WHEN 'v' THEN s END) AS ssim_v, avg(CASE source WHEN 't' THEN s END) AS ssim_t FROM sm GROUP BY ALL)"""


def anchored_sql(delta, visible, thermal):
    return f"(CASE WHEN abs(({visible}) - ({thermal})) < 1e-8 THEN 50 ELSE greatest(0, least(100, 100 * (({delta}) - ({thermal})) / (({visible}) - ({thermal})))) END)"


Q4 = f"""WITH {FUSED}, {pairs_sql("sc", "method, image_id")}, {mi_sql("method, image_id")}, co AS (SELECT method, image_id, {", ".join(f"{c0(f'v{i}', 't')} AS s{i}" for i in range(3))} FROM sc GROUP BY ALL),
sh AS (SELECT method, image_id, unnest([0, 1, 2]) AS ch, unnest([abs(s0), abs(s1), abs(s2)]) AS shared FROM co), bo AS (SELECT method, image_id, ch, max(CASE source WHEN 'v' THEN mi END) AS fv, max(CASE source WHEN 't' THEN mi END) AS ft FROM mi GROUP BY ALL),
d AS (SELECT method, image_id, greatest(0, fv - shared * least(fv, ft)) AS a, greatest(0, ft - shared * least(fv, ft)) AS b FROM bo JOIN sh USING (method, image_id, ch))
SELECT method, image_id, round(avg(CASE WHEN a + b < 1e-8 THEN 50 ELSE 100 * a / (a + b) END), 5) AS value FROM d GROUP BY ALL"""

Q5 = f"""WITH {FUSED}, {pairs_sql("sc", "method, image_id")}, {ssim_sql("method, image_id")} SELECT method, image_id, round(100 / (1 + exp(-5 * (ssim_v - ssim_t))), 5) AS value FROM si"""

GREY = "gr AS (SELECT method, image_id, y, x, (f0 + f1 + f2) / 3 AS f, (v0 + v1 + v2) / 3 AS v, t FROM sc)"


def _agree(a, b):
    return "1.0" if a == b else f"(u{a} * u{b} + n{a} * n{b} + 1) / 2"


def _turn(a, b, by):
    return f"coalesce(sum({_agree(a, b)} * w{by}) / nullif(sum(w{by}), 0), 0)"


_SIZE = anchored_sql(*(f"{c0(f'm{k}', 'mv')} - {c0(f'm{k}', 'mt')}" for k in "fvt"))
_TURN = anchored_sql(*(f"{_turn(k, 'v', k)} - {_turn(k, 't', k)}" for k in "fvt"))
Q6 = f"""WITH {FUSED}, {GREY}, ofs AS (SELECT dy, dx, dx * (2 - abs(dy)) AS wx, dy * (2 - abs(dx)) AS wy FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
ne AS (SELECT method, image_id, y, x, wx, wy, CASE WHEN y + dy < 0 THEN 1 WHEN y + dy > 7 THEN 6 ELSE y + dy END AS qy, CASE WHEN x + dx < 0 THEN 1 WHEN x + dx > 7 THEN 6 ELSE x + dx END AS qx FROM gr, ofs),
so AS (SELECT ne.method, ne.image_id, ne.y, ne.x, {", ".join(f"sum(wx * {k}) AS x{k}, sum(wy * {k}) AS y{k}" for k in "fvt")} FROM ne JOIN gr ON gr.method = ne.method AND gr.image_id = ne.image_id AND gr.y = qy AND gr.x = qx GROUP BY ALL),
le AS (SELECT *, {", ".join(f"sqrt(x{k} * x{k} + y{k} * y{k}) AS m{k}" for k in "fvt")} FROM so), me AS (SELECT method, image_id, {", ".join(f"avg(m{k}) AS mean_{k}" for k in "fvt")} FROM le GROUP BY ALL),
un AS (SELECT le.*, {", ".join(f"CASE WHEN m{k} < 1e-9 THEN 1 ELSE x{k} / m{k} END AS u{k}, CASE WHEN m{k} < 1e-9 THEN 0 ELSE y{k} / m{k} END AS n{k}, CASE WHEN mean_{k} > 1e-12 THEN greatest(0, least(10, m{k} / mean_{k})) ELSE 0 END AS w{k}" for k in "fvt")} FROM le JOIN me USING (method, image_id))
SELECT method, image_id, round(0.5 * {_SIZE} + 0.5 * {_TURN}, 5) AS value FROM un GROUP BY ALL"""

Q8 = f"""WITH {FUSED}, {GREY}, wv AS (SELECT u, v AS k FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS v)), an AS (SELECT gr.*, u, k, 2 * pi() * ((u * y + k * x) % 8) / 8 AS w FROM gr, wv),
re AS (SELECT method, image_id, u, k, {", ".join(f"ln(1 + sqrt(pow(sum({c} * cos(w)), 2) + pow(sum({c} * sin(w)), 2))) AS {c}" for c in "fvt")} FROM an GROUP BY ALL),
co AS (SELECT method, image_id, {", ".join(f"{c0(a, b)} AS {a}{b}" for a, b in ("fv", "ft", "vt"))} FROM re GROUP BY ALL)
SELECT method, image_id, round({anchored_sql("fv - ft", "1 - vt", "vt - 1")}, 5) AS value FROM co"""

_ORDERS = ["0,1,2", "0,2,1", "1,0,2", "1,2,0", "2,0,1", "2,1,0"]


def orders_sql(methods):
    """`ko`: the kept orders of the fused channels, best first."""
    return f"""rr AS (SELECT method, image_id, {", ".join(f"{c0(f'f{i}', f'v{j}')} AS r{i}{j}" for i in range(3) for j in range(3))} FROM sc WHERE method IN ({methods}) GROUP BY ALL),
ors AS (SELECT method, image_id, unnest({_ORDERS}) AS channels, unnest([{", ".join(" + ".join(f"r{p}{j}" for j, p in enumerate(o.split(","))) for o in _ORDERS)}]) AS score FROM rr),
pl AS (SELECT *, row_number() OVER (PARTITION BY method, image_id ORDER BY score DESC, channels) AS place, max(score) OVER (PARTITION BY method, image_id) AS best FROM ors),
ko AS (SELECT method, image_id, place, channels, score FROM pl WHERE place = 1 OR place = 2 AND best - score >= 0.01)"""


Q9 = f"""WITH {FUSED}, {orders_sql("'rgbt', 'rgbt_v2'")} SELECT method, image_id, round(score, 6) AS score, channels FROM ko"""

_OWN = "method, image_id, place"
_SPEARMAN = ", ".join(f"CASE WHEN stddev_pop(f) < 1e-12 OR stddev_pop({k}) < 1e-12 THEN 0 ELSE corr(rank_f, rank_{k}) END AS spearman_{k}" for k in "vt")
Q10 = f"""WITH {FUSED}, {orders_sql("'rgbt'")}, tu AS (SELECT {_OWN}, y, x, v0, v1, v2, t, {", ".join(f"[f0, f1, f2][1 + split_part(channels, ',', {i + 1})::INT] AS f{i}" for i in range(3))} FROM sc JOIN ko USING (method, image_id)),
fl AS (SELECT {_OWN}, y, x, t, unnest([0, 1, 2]) AS ch, unnest([f0, f1, f2]) AS f, unnest([v0, v1, v2]) AS v FROM tu), ra AS (SELECT *, {", ".join(f"row_number() OVER (PARTITION BY {_OWN} ORDER BY {k}, y, x, ch) AS rank_{k}" for k in "fvt")} FROM fl),
ag AS (SELECT {_OWN}, {", ".join(f"{c0('f', k)} AS pearson_{k}, sqrt(avg(pow(f - {k}, 2))) AS rmse_{k}" for k in "vt")}, {_SPEARMAN} FROM ra GROUP BY ALL),
{pairs_sql("tu", _OWN)}, {mi_sql(_OWN)}, {ssim_sql(_OWN)}, mo AS (SELECT {_OWN}, {", ".join(f"avg(CASE source WHEN '{k}' THEN mi END) AS mi_{k}" for k in "vt")} FROM mi GROUP BY ALL)
SELECT method, image_id, {", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for m in ("pearson", "spearman", "mi", "rmse", "ssim") for k in "vt")} FROM ag JOIN mo USING ({_OWN}) JOIN si USING ({_OWN}) GROUP BY ALL"""



def q1(spark, d):
    return rounded(scored(spark, d).groupBy("method", "image_id").agg(*[F.sum(c).alias(c) for c in S.CHANNELS]), *S.CHANNELS)


def q3(spark, d):
    return rounded(S.mutual_info(scored(spark, d), S.GROUP, "f0", "t", 8), "mi", digits=4)


Q3 = f"""WITH {FUSED}, c AS (SELECT method, image_id, least(floor(f0 * 8), 7) AS i, least(floor(t * 8), 7) AS j, count(*) / 64 AS p FROM sc GROUP BY ALL),
r AS (SELECT method, image_id, i, sum(p) AS pi FROM c GROUP BY ALL), k AS (SELECT method, image_id, j, sum(p) AS pj FROM c GROUP BY ALL)
SELECT method, image_id, round(greatest(0, sum((p + 1e-10) / (1 + 64e-10) * ln((p + 1e-10) * (1 + 64e-10) / ((pi + 8e-10) * (pj + 8e-10))))), 4) AS mi FROM c JOIN r USING (method, image_id, i) JOIN k USING (method, image_id, j) GROUP BY ALL"""


def q9(spark, d):
    out = S.prescreen(scored(spark, d, ["rgbt", "rgbt_v2"]))
    return rounded(out.select("method", "image_id", "score", F.array_join("order", ",").alias("channels")), "score")


def q10(spark, d):
    names = [f"{m}_{k}" for m in ("pearson", "spearman", "mi", "rmse", "ssim") for k in "vt"]
    return rounded(S.similarity(scored(spark, d, ["rgbt"])), *names)


def q11(spark, d):
    return rounded(S.channel_redundancy(scored(spark, d)), *S.PRIORS, "redundancy")


def q12(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.col("value") % 100).alias("value"))
    return rounded(S.aggregate_proxies(rows, ["user_id"]), "mean", "std", "confidence", "robust")


Q12 = """WITH e AS (SELECT user_id, value % 100 AS v FROM events), m AS (SELECT user_id, median(v) AS mid, avg(v) AS mean, stddev_pop(v) AS std FROM e GROUP BY 1), d AS (SELECT user_id, greatest(1.4826 * median(abs(v - mid)), 1e-6) AS mad FROM e JOIN m USING (user_id) GROUP BY 1),
w AS (SELECT user_id, v, mean, std, greatest(0.05, least(1, 1 / (1 + pow((v - mid) / mad, 2)))) AS w FROM e JOIN m USING (user_id) JOIN d USING (user_id))
SELECT user_id, round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, round(greatest(0, least(1, 1 - any_value(std) / 35)), 6) AS confidence, round(50 + greatest(0, least(1, 1 - any_value(std) / 35)) * (sum(w * v) / sum(w) - 50), 6) AS robust FROM w GROUP BY user_id"""


def q16(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.array(*[(F.col("p_size") * k % 17 + 0.5).cast("double") for k in (1, 3, 5, 7, 11, 13)]).alias("w"))
    rows = rows.withColumn("c", S.cap_weights(F.col("w")))
    return rows.select("p_partkey", F.round(F.array_max("c"), 6).alias("most"), F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + x), 6).alias("sum"))


def events_as_samples(spark, d):
    """Events as calibration samples: alpha by user, raw score falling with it."""
    alpha = F.round((F.col("user_id") % 11) / 10, 1)
    return table(spark, d, "events").select("user_id", F.when(F.col("user_id") % 2 == 0, F.lit("blend")).otherwise("nonlinear").alias("stype"), F.col("event_type").alias("proxy"), alpha.alias("alpha"), (100 * (1 - alpha) + F.col("value") % 40 - 20).alias("raw"))


SAMPLES = "samples AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'blend' ELSE 'nonlinear' END AS stype, event_type AS proxy, round((user_id % 11) / 10, 1) AS alpha, 100 * (1 - round((user_id % 11) / 10, 1)) + value % 40 - 20 AS raw FROM events)"
KNOTS = f"""{SAMPLES}, md AS (SELECT stype, proxy, alpha, median(raw) AS kx FROM samples GROUP BY ALL), kn AS (SELECT *, 1 - alpha AS v, row_number() OVER (PARTITION BY stype, proxy ORDER BY kx, alpha DESC) AS i FROM md),
mm AS (SELECT a.stype, a.proxy, a.i AS j, b.i AS k, avg(c.v) AS m FROM kn a JOIN kn b ON a.stype = b.stype AND a.proxy = b.proxy AND b.i >= a.i JOIN kn c ON c.stype = a.stype AND c.proxy = a.proxy AND c.i BETWEEN a.i AND b.i GROUP BY ALL),
lo AS (SELECT kn.stype, kn.proxy, i, kx, j, min(m) AS m FROM kn JOIN mm ON kn.stype = mm.stype AND kn.proxy = mm.proxy AND j <= i AND k >= i GROUP BY ALL),
knots AS (SELECT stype, proxy, i, kx, greatest(0, least(1, max(m))) AS ky FROM lo GROUP BY ALL)"""


def q14(spark, d):
    return rounded(C.isotonic_knots(events_as_samples(spark, d), ["stype", "proxy"]), "knot_x", "knot_y")


def q15(spark, d):
    _, weights = C.fit_calibration(events_as_samples(spark, d))
    return rounded(weights.select("stype", "proxy", "w"), "w")


Q15 = f"""WITH {KNOTS}, sg AS (SELECT *, lead(kx) OVER w AS nx, lead(ky) OVER w AS ny FROM knots WINDOW w AS (PARTITION BY stype, proxy ORDER BY kx)), ed AS (SELECT stype, proxy, min(kx) AS a, max(kx) AS z, arg_min(ky, kx) AS ya, arg_max(ky, kx) AS yz FROM knots GROUP BY ALL),
c AS (SELECT s.stype, s.proxy, alpha, CASE WHEN raw < a THEN ya WHEN raw >= z THEN yz ELSE (SELECT ky + (ny - ky) * (raw - kx) / (nx - kx) FROM sg WHERE sg.stype = s.stype AND sg.proxy = s.proxy AND raw >= kx AND raw < nx) END AS cal FROM samples s JOIN ed USING (stype, proxy)),
g AS (SELECT stype, proxy, alpha, stddev_pop(cal) AS s FROM c GROUP BY ALL), w AS (SELECT stype, proxy, 1 / greatest(avg(s), 0.01) AS w FROM g GROUP BY ALL) SELECT stype, proxy, round(w / sum(w) OVER (PARTITION BY stype), 6) AS w FROM w"""


EXACT = Q15.replace("round(w / sum(w) OVER (PARTITION BY stype), 6) AS w", "w / sum(w) OVER (PARTITION BY stype) AS w")


def q17(spark, d):
    _, weights = C.fit_calibration(events_as_samples(spark, d))
    return rounded(C.average_weights(weights), "w")


def q18(spark, d):
    knots, weights = C.fit_calibration(events_as_samples(spark, d))
    values = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("proxy")).agg(F.avg("value").alias("value"))
    cal = C.calibrated(values, knots)
    chosen = C.select_calibration(cal, weights, ["user_id"])
    latent = C.apply_calibration(cal, chosen, C.average_weights(weights), ["user_id"])
    dep = C.apply_alpha_dep(cal, chosen, weights, ["user_id"])
    return rounded(latent.drop("cw").join(dep.drop("trace"), "user_id"), "latent_z", "latent_z_alpha_dep")


def q13(spark, d):
    m = C.synth_mixtures(pixels(spark, d), [0.0, 0.25, 0.5, 0.75, 1.0])
    return m.groupBy("stype", F.round("alpha", 6).alias("alpha")).agg(F.count("*").alias("n"), *[F.round(F.avg(f"f{i}"), 5).alias(f"f{i}") for i in range(3)])


_BANDS = {"a": "1", "h": "(1 - 2 * (y % 2))", "v": "(1 - 2 * (x % 2))", "d": "(1 - 2 * (y % 2)) * (1 - 2 * (x % 2))"}
Q13 = f"""WITH {PIXELS}, al AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha), a AS (SELECT * FROM px, al),
s AS (SELECT *, unnest(['vvv', 'vvt', 'vtv', 'tvv', 'vtt', 'tvt', 'ttv', 'ttt', 'vvm', 'vmv', 'mvv', 'vmt', 'mvt', 'mtv', 'mtt', 'tmt', 'ttm']) AS p FROM px),
hb AS (SELECT image_id, y // 2 AS v, x // 2 AS u, {", ".join(f"sum({c} * {w}) / 2 AS {c}_{k}" for c in "bgrt" for k, w in _BANDS.items())} FROM px GROUP BY ALL),
hs AS (SELECT alpha, {", ".join(f"(1 - alpha) * {c}_a + alpha * t_a AS {c}a, " + ", ".join(f"CASE WHEN abs(t_{k}) * alpha > abs({c}_{k}) * (1 - alpha) THEN t_{k} ELSE {c}_{k} END AS {c}{k}" for k in "hvd") for c in "bgr")} FROM hb, al),
m AS (SELECT 'blend' AS stype, alpha, {", ".join(f"(1 - alpha) * {c} + alpha * t AS f{i}" for i, c in enumerate("bgr"))} FROM a
  UNION ALL SELECT 'nonlinear', alpha, {", ".join(f"255 * least(1.0, pow({c} / 255.0 + 1e-8, 1 - alpha) * pow(t / 255.0 + 1e-8, alpha))" for c in "bgr")} FROM a
  UNION ALL SELECT 'freq_blend', alpha, {", ".join(f"greatest(0.0, least(255.0, ({c}a + i * {c}h + j * {c}v + i * j * {c}d) / 2))" for c in "bgr")} FROM hs, (SELECT unnest([1, -1]) AS i), (SELECT unnest([1, -1]) AS j)
  UNION ALL SELECT 'concat', (length(replace(replace(p, 'v', ''), 'm', '')) + length(replace(replace(p, 'v', ''), 't', '')) / 2.0) / 3, {", ".join(f"CASE substr(p, {i + 1}, 1) WHEN 't' THEN t WHEN 'm' THEN ({c} + t) / 2.0 ELSE {c} END" for i, c in enumerate("bgr"))} FROM s)
SELECT stype, round(alpha, 6) AS alpha, count(*) AS n, round(avg(f0), 5) AS f0, round(avg(f1), 5) AS f1, round(avg(f2), 5) AS f2 FROM m GROUP BY 1, 2"""


def d39(spark, d):
    return rounded(C.calibration_nodes(events_as_samples(spark, d), ["stype", "proxy"]), "median", "sigma", "ideal")


SAMPLE = ["stype", "alpha", "user_id"]


def with_aggregate(spark, d):
    """Events as samples: a user's rows are one sample; with their robust mean as a proxy."""
    return C.with_aggregate(events_as_samples(spark, d), SAMPLE)


def robust_sql(rows, keys, value):
    """Robust mean of groups as common table expressions: `robust` has the keys and `raw`."""
    return f"""ra AS (SELECT {keys}, {value} AS v FROM {rows}), rm AS (SELECT {keys}, median(v) AS mid, avg(v) AS mean, stddev_pop(v) AS std FROM ra GROUP BY ALL),
rd AS (SELECT {keys}, greatest(1.4826 * median(abs(v - mid)), 1e-6) AS mad FROM ra JOIN rm USING ({keys}) GROUP BY ALL), rw AS (SELECT {keys}, v, std, greatest(0.05, least(1, 1 / (1 + pow((v - mid) / mad, 2)))) AS w FROM ra JOIN rm USING ({keys}) JOIN rd USING ({keys})),
robust AS (SELECT {keys}, 50 + greatest(0, least(1, 1 - any_value(std) / 35)) * (sum(w * v) / sum(w) - 50) AS raw FROM rw GROUP BY ALL)"""


#: Knots of all proxies, the aggregate among them, over samples with it.
ALL_KNOTS = SAMPLES.replace("samples AS", "base AS", 1) + ", " + robust_sql("base", "stype, alpha, user_id", "raw") + """, samples AS (SELECT user_id, stype, proxy, alpha, raw FROM base UNION ALL SELECT user_id, stype, 'aggregate', alpha, raw FROM robust)""" + KNOTS.removeprefix(SAMPLES)


def interp_sql(x, where):
    """A value on the knots of `where` (an alias is k), flat at the ends."""
    return f"""(SELECT CASE WHEN {x} < min(kx) THEN arg_min(ky, kx) WHEN {x} >= max(kx) THEN arg_max(ky, kx) ELSE max(CASE WHEN kx <= {x} AND nx > {x} THEN ky + (ny - ky) * ({x} - kx) / (nx - kx) END) END
  FROM (SELECT kx, ky, lead(kx) OVER (ORDER BY kx, ky) AS nx, lead(ky) OVER (ORDER BY kx, ky) AS ny FROM {where}))"""


def d39_latent(spark, d):
    samples = with_aggregate(spark, d)
    knots = C.packed_knots(C.isotonic_knots(samples, ["stype", "proxy"]), ["stype", "proxy"])
    return rounded(C.calibration_nodes(samples, ["stype", "proxy"], knots), "median", "sigma", "ideal", "latent_z")


D39 = f"""WITH {ALL_KNOTS}, nd AS (SELECT stype, proxy, alpha, count(*) AS n, median(raw) AS median, stddev_pop(raw) AS sigma, 100 * (1 - alpha) AS ideal FROM samples GROUP BY ALL)
SELECT stype, proxy, alpha, n, round(median, 6) AS median, round(sigma, 6) AS sigma, round(ideal, 6) AS ideal, round(1 - {interp_sql("nd.median", "knots k WHERE k.stype = nd.stype AND k.proxy = nd.proxy")}, 6) AS latent_z FROM nd"""


def q19(spark, d):
    """Latent shares of customers: by five proxies, which every seventh has not, else by their robust mean."""
    knots, weights = C.fit_calibration(with_aggregate(spark, d))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("bal"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    values = c.filter("c_custkey % 7 <> 0").select("c_custkey", F.explode(F.array(*[F.struct(F.lit(k).alias("proxy"), (F.abs("bal") * (i + 1) % 100).alias("value")) for i, k in enumerate(kinds)])).alias("p")).select("c_custkey", "p.*")
    raw = c.select("c_custkey", (F.abs("bal") % 100).alias("raw"))
    return rounded(C.latent_share(values, raw, knots, weights, ["c_custkey"]), "latent_z")


def d40_latent(spark, d):
    """Deviation of each user's scores by proxy, beside the calibration's at the user's latent share (by the aggregate curve)."""
    samples = with_aggregate(spark, d)
    knots, _ = C.fit_calibration(samples)
    e = table(spark, d, "events").select(F.col("user_id").alias("method"), F.col("event_type").alias("proxy"), "value")
    raw = e.groupBy("method").agg((F.avg("value") % 100).alias("raw"))
    none = e.select("method", "proxy", "value").limit(0)
    latent = C.latent_share(none, raw, knots, C.fit_calibration(samples)[1], ["method"]).select("method", "latent_z")
    methods = e.groupBy("method", "proxy").agg(F.stddev_pop("value").alias("sigma")).join(latent, "method")
    sigmas = C.calibration_sigmas(samples, knots)
    return rounded(C.sigma_at_latent(methods, sigmas), "latent_z", "sigma_empirical", "sigma_calibration_global", "sigma_calibration_at_latent_z")


def q22(spark, d):
    """Calibrates on a fifth of the images (by a seeded split), then evaluates fusion methods on the others, with all proxies."""
    px = placed(pixels(spark, d))
    parts = stored(split_calibration(px.select("image_id").distinct(), "image_id", "q22", ratio=0.2), "parts")
    of = lambda part: px.join(parts.filter(F.col("part") == part).select("image_id"), "image_id")
    knots, weights = C.calibrate(of("calibration"), [0.0, 0.25, 0.5, 0.75, 1.0])
    seen = of("evaluation")
    out = C.evaluate(seen, P.fuse_all(seen, EVALUATED), knots, weights)
    return rounded(C.methods_overview(out, "method", [*S.PROXIES, "robust", "redundancy", "latent_z_alpha_dep", "latent_z"]), "latent_z_mean")


VARIANTS = {"plain": ("none", "none", lambda px: px), "expanded": ("none", "expand", P.equalize_expand)}


def q22_variants(spark, d):
    """Three methods by two proxies, as they are and with the thermal channel equalised; both calibrated by themselves."""
    px = placed(pixels(spark, d))
    parts = stored(split_calibration(px.select("image_id").distinct(), "image_id", "q22", ratio=0.2), "parts")
    out = C.evaluate_variants(px, parts, ["rgbt", "visible", "lwir"], VARIANTS, [0.0, 0.5, 1.0], ["reg", "spectral"])
    return rounded(out.select("variant", "eq_vis", "eq_th", "method", "n", "reg_mean", "spectral_mean", "robust_mean", "latent_z_mean", "latent_z_of_mean", "cont_vis_calibrated"), "reg_mean", "spectral_mean", "robust_mean", "latent_z_mean", "latent_z_of_mean", "cont_vis_calibrated")


CAL = f"""cal AS (SELECT s.stype, s.proxy, s.alpha, {interp_sql("s.raw", "knots k WHERE k.stype = s.stype AND k.proxy = s.proxy")} AS c FROM samples s WHERE s.proxy <> 'aggregate'), sg AS (SELECT stype, proxy, alpha, stddev_pop(c) AS sigma FROM cal GROUP BY ALL)"""
_ROUND = """, c{k} AS (SELECT * REPLACE (CASE WHEN list_sum([greatest(0, x - 0.25) for x in w]) <= 0 OR list_sum([CASE WHEN x > 0.25 THEN 0 ELSE x END for x in w]) <= 0 THEN [least(x, 0.25) for x in w]
  ELSE [CASE WHEN x > 0.25 THEN 0.25 ELSE x + x * list_sum([greatest(0, y - 0.25) for y in w]) / list_sum([CASE WHEN y > 0.25 THEN 0 ELSE y END for y in w]) END for x in w] END AS w) FROM c{j})"""
Q19 = f"""WITH {ALL_KNOTS}, {CAL}, w0 AS (SELECT stype, proxy, 1 / greatest(avg(sigma), 0.01) AS w FROM sg GROUP BY ALL), wt AS (SELECT stype, proxy, w / sum(w) OVER (PARTITION BY stype) AS w FROM w0),
aw AS (SELECT proxy, sum(w) / (SELECT count(DISTINCT stype) FROM wt) AS w FROM wt GROUP BY proxy), va AS (SELECT c_custkey, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS proxy, unnest([abs(c_acctbal::DOUBLE) * i % 100 for i in range(1, 6)]) AS value FROM customer WHERE c_custkey % 7 <> 0),
vc AS (SELECT c_custkey, va.proxy, wt.stype, wt.w, {interp_sql("va.value", "knots k WHERE k.stype = wt.stype AND k.proxy = va.proxy")} AS c FROM va JOIN wt USING (proxy)),
sp AS (SELECT c_custkey, stype, round(sqrt(greatest(0, sum(w * c * c) / sum(w) - pow(sum(w * c) / sum(w), 2))), 12) AS spread FROM vc GROUP BY ALL),
ch AS (SELECT c_custkey, arg_min(stype, (spread, stype)) AS stype FROM sp GROUP BY 1), c0 AS (SELECT c_custkey, stype, list(c ORDER BY proxy) AS c, list(aw.w / (SELECT sum(w) FROM aw) ORDER BY proxy) AS w FROM vc JOIN ch USING (c_custkey, stype) JOIN aw USING (proxy) GROUP BY ALL){"".join(_ROUND.format(j=j, k=j + 1) for j in range(6))},
by_proxies AS (SELECT c_custkey, stype, 1 - list_inner_product(c, w) / list_sum(w) AS z FROM c6)
SELECT c_custkey, coalesce(stype, 'blend') AS stype, round(coalesce(z, 1 - {interp_sql("abs(c_acctbal::DOUBLE) % 100", "knots k WHERE k.stype = 'blend' AND k.proxy = 'aggregate'")}), 6) AS latent_z, z IS NULL AS by_aggregate FROM customer LEFT JOIN by_proxies USING (c_custkey)"""
D40_LATENT = f"""WITH {ALL_KNOTS}, {CAL}, me AS (SELECT user_id AS method, event_type AS proxy, stddev_pop(value) AS sigma FROM events GROUP BY ALL), rw2 AS (SELECT user_id AS method, avg(value) % 100 AS raw FROM events GROUP BY 1),
lz AS (SELECT method, 1 - {interp_sql("rw2.raw", "knots k WHERE k.stype = 'blend' AND k.proxy = 'aggregate'")} AS z FROM rw2), gl AS (SELECT proxy, avg(sigma) AS g FROM sg WHERE stype = 'blend' GROUP BY 1)
SELECT me.method, me.proxy, round(z, 6) AS latent_z, round(me.sigma, 6) AS sigma_empirical, round(g, 6) AS sigma_calibration_global,
  round({interp_sql("lz.z", "(SELECT alpha AS kx, sigma AS ky FROM sg WHERE sg.stype = 'blend' AND sg.proxy = me.proxy) k")}, 6) AS sigma_calibration_at_latent_z FROM me JOIN lz USING (method) LEFT JOIN gl USING (proxy)"""

_SHARES = f"""w0 AS (SELECT stype, proxy, 1 / greatest(avg(sigma), 0.01) AS w FROM sg GROUP BY ALL), wt AS (SELECT stype, proxy, w / sum(w) OVER (PARTITION BY stype) AS w FROM w0), aw AS (SELECT proxy, sum(w) / (SELECT count(DISTINCT stype) FROM wt) AS w FROM wt GROUP BY proxy)"""
Q16 = f"""WITH b AS (SELECT p_partkey, [(p_size * k % 17 + 0.5)::DOUBLE for k in [1, 3, 5, 7, 11, 13]] AS w FROM part), c0 AS (SELECT p_partkey, [x / list_sum(w) for x in w] AS w FROM b){"".join(_ROUND.format(j=j, k=j + 1) for j in range(6))}
SELECT p_partkey, round(list_max(w) / list_sum(w), 6) AS most, round(list_sum([x / list_sum(w) for x in w]), 6) AS "sum" FROM c6"""


def _dependent_sql(i):
    """Round i of weights by the deviation at the last estimate."""
    at = interp_sql("u.z", "(SELECT alpha AS kx, greatest(sigma, 0.01) AS ky FROM sg WHERE sg.stype = u.stype AND sg.proxy = u.proxy) k")
    return f""", i{i} AS (SELECT user_id, list(1 / s ORDER BY proxy) AS w FROM (SELECT user_id, proxy, {at} AS s FROM (SELECT user_id, stype, proxy, z FROM d{i - 1} JOIN vc USING (user_id, stype)) u) GROUP BY 1),
c{i}_0 AS (SELECT user_id, [x / list_sum(w) for x in w] AS w FROM i{i}){"".join(_ROUND.format(j=f"{i}_{j}", k=f"{i}_{j + 1}") for j in range(6))},
n{i} AS (SELECT d{i - 1}.*, 1 - list_inner_product(c, w) / list_sum(w) AS now FROM d{i - 1} JOIN c{i}_6 USING (user_id)),
d{i} AS MATERIALIZED (SELECT user_id, stype, c, CASE WHEN converged THEN z ELSE now END AS z, iterations + (NOT converged)::INT AS iterations, converged OR abs(now - z) < 1e-3 AS converged FROM n{i})"""


Q18 = f"""WITH {KNOTS}, {CAL}, {_SHARES}, va AS (SELECT user_id, event_type AS proxy, avg(value) AS value FROM events GROUP BY ALL),
vc AS MATERIALIZED (SELECT user_id, va.proxy, wt.stype, wt.w, {interp_sql("va.value", "knots k WHERE k.stype = wt.stype AND k.proxy = va.proxy")} AS c FROM va JOIN wt USING (proxy)),
sp AS (SELECT user_id, stype, round(sqrt(greatest(0, sum(w * c * c) / sum(w) - pow(sum(w * c) / sum(w), 2))), 12) AS spread FROM vc GROUP BY ALL), ch AS (SELECT user_id, arg_min(stype, (spread, stype)) AS stype FROM sp GROUP BY 1),
b0 AS (SELECT user_id, stype, list(c ORDER BY proxy) AS c, list(aw.w ORDER BY proxy) AS w FROM vc JOIN ch USING (user_id, stype) JOIN aw USING (proxy) GROUP BY ALL), c0 AS (SELECT * REPLACE ([x / list_sum(w) for x in w] AS w) FROM b0){"".join(_ROUND.format(j=j, k=j + 1) for j in range(6))},
lz AS (SELECT user_id, 1 - list_inner_product(c, w) / list_sum(w) AS latent_z FROM c6), d0 AS MATERIALIZED (SELECT user_id, stype, c, 1 - list_sum(c) / len(c) AS z, 0 AS iterations, false AS converged FROM b0){"".join(_dependent_sql(i) for i in range(1, 5))}
SELECT user_id, stype, round(latent_z, 6) AS latent_z, round(z, 6) AS latent_z_alpha_dep, iterations, converged FROM d4 JOIN lz USING (user_id)"""

_PAIRS = ("01", "12", "02")


def _mean3(p):
    return "(" + " + ".join(f"{p}{k}" for k in _PAIRS) + ") / 3"


def _trust(spread):
    return f"greatest(0.15, least(1, 1 - ({spread}) / 0.25))"


def _spread3(p):
    return "sqrt((" + " + ".join(f"pow({p}{k} - {_mean3(p)}, 2)" for k in _PAIRS) + ") / 3)"


_WEIGHTED = {"pearson": "tp", "spearman": "ts", "tiles": "tt", "rank": "tr"}
Q11 = f"""WITH {FUSED}, rk AS (SELECT *, {", ".join(f"row_number() OVER (PARTITION BY method, image_id ORDER BY f{i}, y, x) AS k{i}" for i in range(3))} FROM sc),
m AS (SELECT method, image_id, {", ".join(f"abs({c0(f'f{a}', f'f{b}')}) AS r{a}{b}, abs(CASE WHEN stddev_pop(f{a}) < 1e-12 OR stddev_pop(f{b}) < 1e-12 THEN 0 ELSE corr(k{a}, k{b}) END) AS s{a}{b}" for a, b in _PAIRS)}, {", ".join(f"covar_samp(f{i}, f{j}) AS c{i}{j}" for i in range(3) for j in range(i, 3))} FROM rk GROUP BY ALL),
ti AS (SELECT method, image_id, y // 2 AS ty, x // 2 AS tx, ({" + ".join(f"abs({c0(f'f{a}', f'f{b}')})" for a, b in _PAIRS)}) / 3 AS score FROM sc GROUP BY ALL), tm AS (SELECT method, image_id, median(score) AS tiles, stddev_pop(score) AS tile_std FROM ti GROUP BY ALL),
e1 AS (SELECT *, (c00 + c11 + c22) / 3 AS q, c01 * c01 + c02 * c02 + c12 * c12 AS off FROM m JOIN tm USING (method, image_id)), e2 AS (SELECT *, sqrt(greatest(1e-300, (pow(c00 - q, 2) + pow(c11 - q, 2) + pow(c22 - q, 2) + 2 * off) / 6)) AS p FROM e1),
e3 AS (SELECT *, (c00 - q) / p AS ex, (c11 - q) / p AS ey, (c22 - q) / p AS ez, c01 / p AS eu, c02 / p AS ev, c12 / p AS ew FROM e2), e4 AS (SELECT *, acos(greatest(-1, least(1, (ex * (ey * ez - ew * ew) - eu * (eu * ez - ew * ev) + ev * (eu * ew - ey * ev)) / 2))) / 3 AS phi FROM e3),
e5 AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM e4), e6 AS (SELECT *, [greatest(0, l1), greatest(0, 3 * q - l1 - l3), greatest(0, l3)] AS l FROM e5),
e7 AS (SELECT *, list_sum(l) AS trace, -list_sum([CASE WHEN x / list_sum(l) > 1e-12 THEN x / list_sum(l) * ln(x / list_sum(l)) ELSE 0 END for x in l]) AS entropy FROM e6),
pa AS (SELECT method, image_id, {_mean3("r")} AS pearson, {_mean3("s")} AS spearman, tiles, CASE WHEN trace <= 1e-12 THEN 1 ELSE greatest(0, least(1, (3 - exp(entropy)) / 2)) END AS rank,
  {S.PRIORS["pearson"]} * {_trust(_spread3("r"))} AS tp, {S.PRIORS["spearman"]} * {_trust(_spread3("s"))} AS ts, {S.PRIORS["tiles"]} * {_trust("tile_std")} AS tt, {S.PRIORS["rank"]} * greatest(0.2, least(1, len([x for x in l if x > 1e-10]) / 3)) AS tr FROM e7)
SELECT method, image_id, {", ".join(f"round({k}, 6) AS {k}" for k in S.PRIORS)}, round(greatest(0, least(1, ({" + ".join(f"{w} * {k}" for k, w in _WEIGHTED.items())}) / ({" + ".join(_WEIGHTED.values())}))), 6) AS redundancy FROM pa"""

EVALUATED = ["rgbt", "rgbt_v2", "visible", "lwir", "hsvt", "wavelet", "pca"]


PLANS = {
    "q1_normalize": (q1, f"WITH {FUSED} SELECT method, image_id, " + ", ".join(f"round(sum({c}), 6) AS {c}" for c in S.CHANNELS) + " FROM sc GROUP BY ALL"),
    "q2_reg": (proxy("reg"), REG), "q3_mutual_info": (q3, Q3), "q4_mi": (proxy("mi"), Q4), "q5_ssim": (proxy("ssim"), Q5), "q6_grad": (proxy("grad"), Q6), "q7_spectral": (proxy("spectral"), SPECTRAL), "q8_freq": (proxy("freq"), Q8),
    "q9_prescreen": (q9, Q9), "q10_similarity": (q10, Q10), "q11_redundancy": (q11, Q11), "q12_robust": (q12, Q12), "q13_mixtures": (q13, Q13),
    "q14_isotonic": (q14, f"WITH {KNOTS} SELECT stype, proxy, i::INT AS i, round(kx, 6) AS knot_x, round(ky, 6) AS knot_y FROM knots"),
    "q15_weights": (q15, Q15), "q16_cap_weights": (q16, Q16), "q17_average_weights": (q17, f"WITH q AS ({EXACT}) SELECT proxy, round(sum(w) / 2, 6) AS w FROM q GROUP BY proxy"),
    "q18_latent": (q18, Q18), "q22_evaluate": (q22, None), "q22_variants": (q22_variants, None),
    "q19_latent": (q19, Q19), "d39_latent": (d39_latent, D39), "d40_at_latent": (d40_latent, D40_LATENT),
    "d39_nodes": (d39, f"WITH {SAMPLES} SELECT stype, proxy, alpha, count(*) AS n, round(median(raw), 6) AS median, round(stddev_pop(raw), 6) AS sigma, round(100 * (1 - alpha), 6) AS ideal FROM samples GROUP BY ALL"),
}
