"""Known answers and invariants of operators that SQL doesn't cover."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolume.functions import boxes as B
from duolume.functions import names as N
from duolume.operators import calibration as C
from duolume.operators import pixels as P
from duolume.operators import sampling as S
from duolume.operators import scores as Q
from duolume.operators import stats as T

RNG = np.random.default_rng(7)


def image(spark, b, g, r, t, image_id=0):
    h, w = b.shape
    rows = [(image_id, y, x, *[float(c[y, x]) for c in (b, g, r, t)]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, b double, g double, r double, t double")


def noise(n=8):
    return RNG.integers(0, 256, (n, n)).astype(float)


@pytest.fixture(scope="module")
def px(spark):
    return image(spark, *[noise() for _ in range(4)]).persist()


def channels(df):
    rows = df.orderBy("y", "x").collect()
    return np.array([r["c"] for r in rows])


def test_average_of_a_channel_with_itself_is_itself(spark):
    a = noise()
    assert (channels(P.fuse(image(spark, a, a, a, a), "rgbt"))[:, 0] == a.ravel()).all()


def test_norm255_of_a_constant_is_zero(spark):
    a = np.full((4, 4), 9.0)
    assert (channels(P.norm255(P.fuse(image(spark, a, a, a, a), "visible"))) == 0).all()


def test_norm255_spans_the_range(px):
    c = channels(P.norm255(P.fuse(px, "visible")))
    assert c.min() == 0 and c.max() == 255


def test_hsv_round_trip(px):
    b, g, r = (F.col(c) for c in "bgr")
    rows = px.select("b", "g", "r", F.array(*P.from_hsv(*P.hsv(b, g, r))).alias("c")).collect()
    # hue has 180 steps, so a channel may be off by some levels
    assert max(abs(x[c] - x["c"][i]) for x in rows for i, c in enumerate("bgr")) <= 8


def test_haar_inverts(px):
    back = P.inverse_haar(P.haar(px, ["b", "t"]), ["b", "t"])
    both = px.select(*P.KEYS, F.col("b").alias("b0"), F.col("t").alias("t0")).join(back, list(P.KEYS))
    assert both.filter((F.abs(F.col("b") - F.col("b0")) > 1e-9) | (F.abs(F.col("t") - F.col("t0")) > 1e-9)).count() == 0 and both.count() == 64


def test_convolve_matches_numpy(spark):
    v = RNG.normal(size=20)
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "k int, i int, v double")
    kernel = P.gauss_kernel(3)
    padded = np.pad(v, 12, mode="symmetric")
    want = np.convolve(padded, kernel, mode="valid")
    got = [r["v"] for r in P.smooth(df, ["k"], "i", "v", 3).orderBy("i").collect()]
    assert np.allclose(got, want)


def test_pca_scores_are_uncorrelated(px):
    moments = P._moments(px, ["image_id"], list(P.ALL))
    c = channels(P._project(px, P._solved(moments, ["image_id"], list(P.ALL), P._components), ["image_id"], list(P.ALL), 3))
    cov = np.cov(c.T)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-6) and cov[0, 0] >= cov[1, 1] >= cov[2, 2]


def test_clahe_keeps_all_pixels_in_range(px):
    rows = P.clahe(px, 8, 8, tiles=2).collect()
    assert len(rows) == 64 and all(0 <= r["t"] <= 255 for r in rows)


def test_warp_by_the_identity_is_the_identity(spark, px):
    one = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "image_id long, a double, b double, c double, d double, e double, f double")
    assert P.warp(px, one, 8, 8).exceptAll(px).count() == 0


@pytest.mark.parametrize("method", [*P.FUSIONS, *P.IMAGE_FUSIONS])
def test_each_fusion_gives_every_pixel(px, method):
    out = P.fuse(px, method)
    assert out.columns == [*P.KEYS, "c"] and out.count() == 64


def test_anchors_of_scores(spark, px):
    fused = P.fuse_all(px, ["visible", "lwir"])
    scores = Q.proxies(Q.score_table(px, fused), ["reg", "grad", "freq", "spectral"])
    got = {(r["method"], r["proxy"]): r["value"] for r in scores.collect()}
    for proxy in ("grad", "freq", "spectral"):
        assert got["visible", proxy] == pytest.approx(100) and got["lwir", proxy] == pytest.approx(0)
    assert got["visible", "reg"] == pytest.approx(100) and got["lwir", "reg"] == pytest.approx(0)


def test_redundancy_of_copies_is_one(px):
    row = Q.channel_redundancy(Q.score_table(px, P.fuse_all(px, ["lwir"]))).first()
    assert row["redundancy"] == pytest.approx(1) and row["rank"] == pytest.approx(1, abs=1e-6)


def test_closed_form_eigenvalues(spark):
    a = RNG.normal(size=(3, 3))
    m = a @ a.T
    row = spark.range(1).select(F.array(*Q.eigenvalues3(*[F.lit(float(x)) for x in (m[0, 0], m[1, 1], m[2, 2], m[0, 1], m[0, 2], m[1, 2])])).alias("e")).first()
    assert np.allclose(sorted(row["e"]), np.linalg.eigvalsh(m))


def test_capped_weights(spark):
    df = spark.createDataFrame([([10.0, 1.0, 1.0, 1.0, 1.0, 1.0],), ([5.0, 5.0, 1.0, 1.0, 1.0, 0.5],), ([0.0] * 6,), ([1.0] * 6,)], "w array<double>")
    for (w,) in df.select(Q.cap_weights(F.col("w"))).collect():
        assert sum(w) == pytest.approx(1) and max(w) <= 0.25 + 1e-9


def test_isotonic_knots_against_pool_adjacent_violators(spark):
    values = [(0.0, 9.0), (0.2, 7.0), (0.4, 8.0), (0.6, 3.0), (0.8, 4.0), (1.0, 1.0)]
    df = spark.createDataFrame([("p", a, r) for a, r in values], "proxy string, alpha double, raw double")
    got = [r["knot_y"] for r in C.isotonic_knots(df, ["proxy"]).orderBy("i").collect()]
    blocks = [[1 - a, 1] for _, a in sorted((r, a) for a, r in values)]
    out = []
    for v, n in blocks:
        out.append([v, n])
        while len(out) > 1 and out[-2][0] > out[-1][0]:
            v2, n2 = out.pop()
            out[-1] = [(out[-1][0] * out[-1][1] + v2 * n2) / (out[-1][1] + n2), out[-1][1] + n2]
    assert np.allclose(got, [v for v, n in out for _ in range(n)])


def test_calibrated_share_of_blends(spark, px):
    mixtures = C.synth_mixtures(px, [0.0, 0.5, 1.0])
    fused = mixtures.select(F.concat_ws("|", "stype", "alpha").alias("method"), "image_id", "y", "x", F.array("f0", "f1", "f2").alias("c"))
    raw = Q.proxies(Q.score_table(px, fused), ["reg"])
    got = {r["method"]: r["value"] for r in raw.collect()}
    assert got["blend|0.0"] == pytest.approx(100) and got["blend|1.0"] == pytest.approx(0) and 20 < got["blend|0.5"] < 80


def test_anova_within_groups(spark):
    rows = [(g, f"a{i % 3}", f"b{i % 4}", float((i * 7 + len(g) * i * i) % 23)) for g in ("x", "yy") for i in range(60)] + [("x", None, "b0", 1.0), ("yy", "a0", "b0", None)]
    df = spark.createDataFrame(rows, "g string, a string, b string, y double")
    got = {(r["g"], r["term"]): tuple(r)[2:] for r in T.anova2_within(df, "g", "a", "b", "y").collect()}
    want = {(g, r["term"]): tuple(r)[1:] for g in ("x", "yy") for r in T.anova2(df.filter(F.col("g") == g), "a", "b", "y").collect()}
    assert set(got) == set(want) and all(x == pytest.approx(y) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_anova_against_least_squares(spark):
    rows = [(a, b, float(RNG.normal() + a + 2 * b)) for a in range(3) for b in range(2) for _ in range(4 + a)]
    df = spark.createDataFrame(rows, "a int, b int, y double")
    got = {r["term"]: r for r in T.anova2(df, "a", "b", "y").collect()}
    y = np.array([r[2] for r in rows])
    da, db = np.eye(3)[[r[0] for r in rows]], np.eye(2)[[r[1] for r in rows]]

    def rss(x):
        return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())

    both = rss(np.hstack([da, db]))
    assert got["a"]["sum_sq"] == pytest.approx(rss(db) - both) and got["b"]["sum_sq"] == pytest.approx(rss(da) - both) and got["a"]["df"] == 2
    cells = rss(np.einsum("ni,nj->nij", da, db).reshape(len(y), -1))
    assert got["a:b"]["sum_sq"] == pytest.approx(both - cells) and got["Residual"]["sum_sq"] == pytest.approx(cells)
    assert 0 <= got["a:b"]["p"] <= 1


@pytest.mark.parametrize(("f", "d1", "d2", "p"), [(4.9646, 1, 10, 0.05), (3.4928, 2, 20, 0.05), (1.0, 5, 5, 0.5)])
def test_f_tail(f, d1, d2, p):
    assert T.f_tail(f, d1, d2) == pytest.approx(p, abs=1e-4)


def test_nested_ols_against_numpy(spark):
    x = RNG.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.0] + RNG.normal(size=60)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "x0 double, x1 double, x2 double, y double")
    rows = T.nested_ols(df, "y", ["x0", "x1", "x2"]).collect()
    beta = np.linalg.lstsq(np.hstack([np.ones((60, 1)), x]), y, rcond=None)[0]
    assert np.allclose(rows[2]["betas"], beta) and rows[0]["r2"] <= rows[1]["r2"] <= rows[2]["r2"]


def test_pca_report_explains_everything(spark):
    x = RNG.normal(size=(50, 3)) @ RNG.normal(size=(3, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    rows = T.pca_report(df, ["a", "b", "c"]).collect()
    assert np.allclose([r["eigenvalue"] for r in rows], sorted(np.linalg.eigvalsh(np.corrcoef(x.T)), reverse=True)) and rows[-1]["cumulative"] == pytest.approx(1)


def test_quotas_sum_to_the_sample(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(101)] + [(1000, "c")], "id long, k string")
    for n in (1, 7, 50, 102, 500):
        assert S.stratified_sample(df, "k", "id", n, "s").count() == min(n, 102)


def test_calibration_split_never_takes_all(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    parts = S.split_calibration(df, "k", "s", ratio=1.0).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"calibration": 9, "evaluation": 1}


def test_affine_inverse(spark):
    df = spark.createDataFrame([(2.0, 1.0, 5.0, 0.5, 3.0, -1.0)], "a double, b double, c double, d double, e double, f double")
    r = B.invert_affine(df).first()
    m = np.array([[2.0, 1, 5], [0.5, 3, -1], [0, 0, 1]]) @ np.array([[r["a"], r["b"], r["c"]], [r["d"], r["e"], r["f"]], [0, 0, 1]])
    assert np.allclose(m, np.eye(3))


def test_normalised_boxes_come_back(spark):
    df = spark.createDataFrame([(10.0, 20.0, 100.0, 50.0)], "x double, y double, w double, h double")
    r = B.denormalize_boxes(B.normalize_boxes(df)).first()
    assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (10, 20, 110, 70)


@pytest.mark.parametrize(("name", "want"), [("kaist_wavelet_max_day", ("kaist", "wavelet_max", "day")), ("kaist_visible", ("kaist", "visible", "")), ("kaist", ("kaist", "", "")), ("kaist_pca_dusk", ("kaist", "pca_dusk", ""))])
def test_parse_name(spark, name, want):
    r = spark.range(1).select(N.parse_name(F.lit(name)).alias("n")).first()["n"]
    assert (r["dataset"], r["method"], r["condition"]) == want


def test_unknown_fusion_is_an_error_row(px):
    rows = P.fuse_all(px, ["rgbt", "nothing"]).filter("_error is not null").collect()
    assert [r["method"] for r in rows] == ["nothing"]


def test_empty_tables(spark, px):
    empty = px.limit(0)
    assert P.histograms(empty).count() == 0 and P.norm255(P.fuse(empty, "rgbt")).count() == 0 and P.sobel(empty, ["t"]).count() == 0
