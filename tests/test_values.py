"""Pixel and score queries without SQL, against plain numpy on every image."""

from __future__ import annotations

import colorsys
from fractions import Fraction
from itertools import permutations

import numpy as np
import pandas as pd
import pytest

from duolume.plans.registry import plans

SF = "/root/testdata/sf0.001"
PLANS = plans()


@pytest.fixture(scope="module")
def images():
    """image_id -> 8 x 8 x 4 array of b, g, r, t."""
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    v = np.stack(e["embedding"].to_numpy()).astype(float)
    p = np.clip(np.floor(255 * (v + 0.6) / 1.2), 0, 255).reshape(-1, 4, 8, 8)
    return {int(i): p[k].transpose(1, 2, 0) for k, i in enumerate(e["vec_id"].to_numpy()[::4] // 4)}


def norm255(c):
    low, high = c.min(), c.max()
    return np.zeros_like(c) if high - low <= 1e-8 else np.floor(255 * ((c - low) / (high - low)))


def stretch(a):
    return (a - a.min()) / (a.max() - a.min()) if a.max() - a.min() >= 1e-12 else np.zeros_like(a)


def blur(a, sigma=2):
    k = np.exp(-0.5 * (np.arange(-8, 9) / sigma) ** 2)
    for axis in (1, 0):
        padded = np.pad(a, [(8, 8) if d == axis else (0, 0) for d in (0, 1)], mode="symmetric")
        a = np.apply_along_axis(lambda line: np.convolve(line, k / k.sum(), "valid"), axis, padded)
    return a


def ssim_map(a, b, size, span):
    r, out = size // 2, np.zeros(a.shape)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            p, q = (m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].ravel() for m in (a, b))
            c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
            cov = np.mean(p * q) - p.mean() * q.mean()
            out[y, x] = (2 * p.mean() * q.mean() + c1) * (2 * cov + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (p.var() + q.var() + c2))
    return out


def by_ssim(swap):
    def run(p):
        t, out = p[..., 3], []
        for i in range(3):
            m = stretch(blur(ssim_map(p[..., i], t, 11, 255.0)))
            out.append(m * p[..., i] + (1 - m) * t if swap else (1 - m) * p[..., i] + m * t)
        return norm255(np.stack(out, -1))

    return run


def superpixel(p):
    m = np.zeros((8, 8))
    for y in (0, 4):
        for x in (0, 4):
            s = p[y : y + 4, x : x + 4].reshape(16, 4).std(axis=0)
            m[y : y + 4, x : x + 4] = 1 / (1 + np.exp(-(s[:3].mean() - s[3])))
    m = stretch(blur(stretch(m)))[..., None]
    return norm255(m * p[..., :3] + (1 - m) * p[..., 3:])


def wavelet_max(p):
    sign = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, 1, -1], [1, -1, -1, 1]]) / 2
    blocks = p.reshape(4, 2, 4, 2, 4).transpose(0, 2, 4, 1, 3).reshape(4, 4, 4, 4)
    bands = blocks @ sign.T  # y, x, channel, band
    t = bands[:, :, 3:]
    picked = np.where(np.abs(bands[:, :, :3]) > np.abs(t), bands[:, :, :3], t)
    w = (t[..., 0] / 2 / p[..., 3].max()) if p[..., 3].max() > 0 else np.zeros_like(t[..., 0])
    picked[..., 0] = (1 - w) * bands[:, :, :3, 0] + w * t[..., 0]
    back = (picked @ sign).reshape(4, 4, 3, 2, 2).transpose(0, 3, 1, 4, 2).reshape(8, 8, 3)
    return norm255(back)


def components(rows, n):
    _, _, vt = np.linalg.svd(rows - rows.mean(axis=0), full_matrices=False)
    w = vt[:n]
    return (rows - rows.mean(axis=0)) @ (w * np.sign(w[np.arange(n), np.abs(w).argmax(axis=1)])[:, None]).T


def pca_std(p, n=3):
    rows = p.reshape(64, 4)
    s = rows.std(axis=0, ddof=1)
    out = norm255(components((rows - rows.mean(axis=0)) / np.where(s > 0, s, 1), n)).reshape(8, 8, n)
    return np.repeat(out, 3, axis=2) if n == 1 else out


def alpha_pca(p):
    grey, t = p[..., :3] @ [0.114, 0.587, 0.299], p[..., 3]
    v = np.abs(np.linalg.eigh(np.cov(grey.ravel(), t.ravel(), bias=True))[1][:, -1])
    mixed = v[0] * grey + v[1] * t
    ratio = np.where(grey[..., None] > 0, p[..., :3] / np.where(grey > 0, grey, 1)[..., None], 1)
    return np.clip(np.floor(ratio * mixed[..., None]), 0, 255)


def hsvt(p):
    """Hue and saturation by fractions, since halves are frequent."""
    out = np.zeros((8, 8, 3))
    for y in range(8):
        for x in range(8):
            b, g, r, t = (int(c) for c in p[y, x])
            v, d = max(b, g, r), max(b, g, r) - min(b, g, r)
            turn = Fraction(0) if d == 0 else Fraction(g - b, d) % 6 if v == r else Fraction(b - r, d) + 2 if v == g else Fraction(r - g, d) + 4
            hue, s = int(turn * 30 + Fraction(1, 2)) % 180, int(Fraction(255 * d, v or 1) + Fraction(1, 2))
            rgb = colorsys.hsv_to_rgb(hue / 180, s / 255, (v + t) // 2 / 255)
            out[y, x] = np.floor(np.array(rgb[::-1]) * 255 + 0.5)
    return out


FUSIONS = {"ssim": by_ssim(False), "ssim_v2": by_ssim(True), "superpixel": superpixel, "wavelet_max": wavelet_max, "pca": lambda p: norm255(components(p.reshape(64, 4), 3)).reshape(8, 8, 3), "pca_std": pca_std, "pca_1ch": lambda p: pca_std(p, 1), "alpha_pca": alpha_pca, "hsvt": hsvt}


@pytest.mark.parametrize("method", list(FUSIONS))
def test_fusions(spark, images, method):
    got = PLANS[f"p_{method}"][0](spark, SF).toPandas().set_index("image_id")
    assert set(got.index) == set(images)
    place = np.arange(64).reshape(8, 8)
    for i, p in images.items():
        c = FUSIONS[method](p)
        # a last bit may turn a truncated value by one
        assert got.loc[i, "n"] == 64
        assert np.abs(got.loc[i, ["s0", "s1", "s2"]].to_numpy(float) - c.sum(axis=(0, 1))).max() <= 2, (i, got.loc[i], c.sum(axis=(0, 1)))
        assert np.abs(got.loc[i, ["w0", "w1", "w2"]].to_numpy(float) - (c * place[..., None]).sum(axis=(0, 1))).max() <= 126


# ---- scores


def scaled(c):
    c = c.astype(float)
    low, high = c.min(axis=(0, 1)), c.max(axis=(0, 1))
    return np.where(high - low < 1e-12, 0.5, (c - low) / np.where(high - low < 1e-12, 1, high - low))


@pytest.fixture(scope="module")
def scored(images):
    """(method, image_id) -> visible, thermal (three copies), fused."""
    out = {}
    for i, p in images.items():
        v, t = p[..., :3], np.repeat(p[..., 3:], 3, axis=2)
        for m, f in {"rgbt": np.floor(255 * (v + t) / 510), "rgbt_v2": np.floor(255 * v * t / 65025), "visible": v, "lwir": t}.items():
            out[m, i] = scaled(v), scaled(t), scaled(f)
    return out


def corr(a, b):
    return 0.0 if a.std() < 1e-12 or b.std() < 1e-12 else np.corrcoef(a.ravel(), b.ravel())[0, 1]


def information(a, b, bins=128):
    n, _, _ = np.histogram2d(a.ravel(), b.ravel(), bins=bins, range=[[0, 1], [0, 1]])
    p = n / n.sum() + 1e-10
    p /= p.sum()
    return max(0.0, float((p * np.log(p / np.outer(p.sum(1), p.sum(0)))).sum()))


def anchored(delta, visible, thermal):
    return 50.0 if abs(visible - thermal) < 1e-8 else min(100.0, max(0.0, 100 * (delta - thermal) / (visible - thermal)))


def score_mi(v, t, f):
    out = []
    for c in range(3):
        a, b = information(f[..., c], v[..., c]), information(f[..., c], t[..., c])
        common = abs(corr(v[..., c], t[..., c])) * min(a, b)
        a, b = max(0, a - common), max(0, b - common)
        out.append(50 if a + b < 1e-8 else 100 * a / (a + b))
    return np.mean(out)


def inner_ssim(a, b, size=7):
    """Whole windows only, sample variances."""
    out = []
    for c in range(3):
        for y in range(9 - size):
            for x in range(9 - size):
                k = np.cov(*(m[y : y + size, x : x + size, c].ravel() for m in (a, b)))
                p, q = (m[y : y + size, x : x + size, c].mean() for m in (a, b))
                out.append((2 * p * q + 1e-4) * (2 * k[0, 1] + 9e-4) / ((p * p + q * q + 1e-4) * (k[0, 0] + k[1, 1] + 9e-4)))
    return np.mean(out)


def score_ssim(v, t, f):
    return 100 / (1 + np.exp(-5 * (inner_ssim(f, v) - inner_ssim(f, t))))


def gradient(a):
    p = np.pad(a, 1, mode="reflect")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return gx, gy, np.hypot(gx, gy)


def score_grad(v, t, f):
    g = {k: gradient(x) for k, x in (("f", f.mean(-1)), ("v", v.mean(-1)), ("t", t[..., 0]))}
    angle = {k: np.where(m < 1e-9, 0, np.arctan2(y, x)) for k, (x, y, m) in g.items()}

    def agree(a, b, by):
        w = np.clip(g[by][2] / (g[by][2].mean() + 1e-12), 0, 10)
        return ((np.cos(angle[a] - angle[b]) + 1) / 2 * w).sum() / (w.sum() + 1e-12)

    size = {a + b: corr(g[a][2], g[b][2]) for a in "fvt" for b in "fvt"}
    first = anchored(size["fv"] - size["ft"], size["vv"] - size["vt"], size["vt"] - size["tt"])
    return (first + anchored(agree("v", "f", "f") - agree("t", "f", "f"), agree("v", "v", "v") - agree("t", "v", "v"), agree("v", "t", "t") - agree("t", "t", "t"))) / 2


def score_freq(v, t, f):
    k = {n: np.log1p(np.abs(np.fft.fft2(x))) for n, x in (("f", f.mean(-1)), ("v", v.mean(-1)), ("t", t[..., 0]))}
    return anchored(corr(k["f"], k["v"]) - corr(k["f"], k["t"]), 1 - corr(k["v"], k["t"]), corr(k["v"], k["t"]) - 1)


@pytest.mark.parametrize("query,score", [("q4_mi", score_mi), ("q5_ssim", score_ssim), ("q6_grad", score_grad), ("q8_freq", score_freq)])
def test_scores(spark, scored, query, score):
    got = PLANS[query][0](spark, SF).toPandas().set_index(["method", "image_id"])["value"]
    assert set(got.index) == set(scored)
    for k, (v, t, f) in scored.items():
        assert got[k] == pytest.approx(score(v, t, f), abs=2e-3), k


def kept_orders(v, f):
    s = sorted(((-sum(corr(f[..., p[j]], v[..., j]) for j in range(3)), p) for p in permutations(range(3))))[:2]
    return s[:1] if s[1][0] - s[0][0] < 0.01 else s


def test_orders(spark, scored):
    got = PLANS["q9_prescreen"][0](spark, SF).toPandas()
    have = {(r.method, r.image_id, r.channels): r.score for r in got.itertuples()}
    want = {(*k, ",".join(map(str, p))): -s for k, (v, _, f) in scored.items() if k[0] in ("rgbt", "rgbt_v2") for s, p in kept_orders(v, f)}
    assert set(have) == set(want) and all(abs(have[k] - want[k]) < 1e-5 for k in want)


def ranks(a):
    return np.argsort(np.argsort(a.ravel(), kind="stable"), kind="stable").astype(float)


def test_similarity(spark, scored):
    got = PLANS["q10_similarity"][0](spark, SF).toPandas().set_index(["method", "image_id"])
    for k, (v, t, f) in scored.items():
        if k[0] != "rgbt":
            continue
        for name, o in (("v", v), ("t", t)):
            turned = [f[..., list(p)] for _, p in kept_orders(v, f)]
            want = {
                "pearson": [corr(x, o) for x in turned], "spearman": [np.corrcoef(ranks(x), ranks(o))[0, 1] for x in turned], "rmse": [np.sqrt(((x - o) ** 2).mean()) for x in turned],
                "mi": [np.mean([information(x[..., c], o[..., c]) for c in range(3)]) for x in turned], "ssim": [inner_ssim(x, o) for x in turned],
            }
            for m, values in want.items():
                assert got.loc[k, f"{m}_{name}"] == pytest.approx(np.mean(values), abs=1e-4), (k, m, name)


def equalised(c, clip=6.0, tiles=2):
    """Contrast-limited equalisation of one plane, pixel by pixel."""
    n = c.shape[0] // tiles
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            h = np.bincount(c[i * n : (i + 1) * n, j * n : (j + 1) * n].astype(int).ravel(), minlength=256).astype(float)
            limit = max(1, int(clip * n * n / 256))
            over = np.maximum(h - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(h, limit) + over / 256) * 255 / (n * n)
    out = np.zeros_like(c)
    for y in range(c.shape[0]):
        for x in range(c.shape[1]):
            fy, fx = (y + 0.5) / n - 0.5, (x + 0.5) / n - 0.5
            y0, x0 = int(np.floor(fy)), int(np.floor(fx))
            out[y, x] = sum((fy - y0 if a else 1 - fy + y0) * (fx - x0 if b else 1 - fx + x0) * maps[min(max(y0 + a, 0), tiles - 1), min(max(x0 + b, 0), tiles - 1), int(c[y, x])] for a in (0, 1) for b in (0, 1))
    return np.floor(np.clip(out, 0, 255))


def test_clahe(spark, images):
    got = {x["image_id"]: x["t"] for x in PLANS["p21_clahe"][0](spark, SF).collect()}
    assert set(got) == set(images) and all(abs(equalised(v[:, :, 3]).mean() - got[k]) < 1e-4 for k, v in images.items())


def test_clahe_of_colour(spark, images):
    """Luma by exact fractions of 2^14, chroma and the way back by real arithmetic to within two grey levels."""
    got = {k: g.sort_values(["y", "x"])[["b", "g", "r"]].to_numpy().reshape(8, 8, 3) for k, g in PLANS["p21_clahe_color"][0](spark, SF).toPandas().groupby("image_id")}
    for k, v in images.items():
        b, g, r = (v[:, :, i] for i in range(3))
        luma = np.floor((np.round(0.299 * 2**14) * r + np.round(0.587 * 2**14) * g + np.round(0.114 * 2**14) * b) / 2**14 + 0.5)
        cr, cb = (np.clip(np.floor((c - luma) * f + 128 + 0.5), 0, 255) for c, f in ((r, 0.713), (b, 0.564)))
        new = equalised(luma)
        want = np.stack([new + 1.773 * (cb - 128), new - 0.714 * (cr - 128) - 0.344 * (cb - 128), new + 1.403 * (cr - 128)], axis=2)
        assert np.abs(got[k] - np.clip(want, 0, 255)).max() <= 2.5


def test_bilinear_warp(spark, images):
    got = {k: {(y, x): c for y, x, *c in g[["y", "x", "b", "g", "r", "t"]].to_numpy().tolist()} for k, g in PLANS["p24_warp_bilinear"][0](spark, SF).toPandas().groupby("image_id")}
    for k, v in images.items():
        want = {}
        for y in range(8):
            for x in range(8):
                sx, sy = x + 0.25 * y + k % 3 / 2, -0.125 * x + y + 0.5
                x0, y0 = int(np.floor(sx)), int(np.floor(sy))
                near = [(y0 + i, x0 + j, (sy - y0 if i else 1 - sy + y0) * (sx - x0 if j else 1 - sx + x0)) for i in (0, 1) for j in (0, 1)]
                near = [n for n in near if n[2] > 0]
                if all(0 <= a < 8 and 0 <= b < 8 for a, b, _ in near):
                    want[y, x] = sum(w * v[a, b] for a, b, w in near)
        assert set(got.get(k, {})) == set(want)
        assert all(np.allclose(got[k][p], c, atol=1e-5) for p, c in want.items())


# ---- components and factors of images, scores of rows, the whole evaluation


def factors(rows, n=3, rounds=200):
    """Posterior means of a factor analysis: expectation and maximisation over the rows themselves."""
    x = rows - rows.mean(axis=0)
    share = 1 / (len(x) - 1)
    cov = x.T @ x * share
    noise = np.maximum(np.diag(cov) / 2, 1e-6)
    values, vectors = np.linalg.eigh(cov)
    load = vectors[:, ::-1][:, :n] * np.sqrt(np.maximum(values[::-1][:n], 1e-9) / 2)
    for _ in range(rounds):
        scaled_load = load / noise[:, None]
        spread = np.linalg.inv(np.eye(n) + load.T @ scaled_load)
        z = x @ scaled_load @ spread
        load = (x.T @ z * share) @ np.linalg.inv(spread + z.T @ z * share)
        noise = np.maximum((x * (x - z @ load.T)).sum(axis=0) * share, 1e-6)
    w = np.linalg.solve(load @ load.T + np.diag(noise + 1e-9), load).T
    return x @ (w * np.sign(w[np.arange(n), np.abs(w).argmax(axis=1)])[:, None]).T


def hsv_and_thermal(p):
    """Hue, saturation and value by fractions, and the thermal channel."""
    out = []
    for b, g, r, t in p.reshape(-1, 4).astype(int).tolist():
        v, d = max(b, g, r), max(b, g, r) - min(b, g, r)
        turn = Fraction(0) if d == 0 else Fraction(g - b, d) % 6 if v == r else Fraction(b - r, d) + 2 if v == g else Fraction(r - g, d) + 4
        out.append([int(turn * 30 + Fraction(1, 2)) % 180, int(Fraction(255 * d, v or 1) + Fraction(1, 2)), v, t])
    return np.array(out, dtype=float)


def standard_components(rows, n=3):
    s = rows.std(axis=0, ddof=1)
    return components((rows - rows.mean(axis=0)) / np.where(s > 0, s, 1), n)


def fitted(images, method):
    if method == "pca_full":
        every = components(np.concatenate([images[i].reshape(64, 4) for i in sorted(images)]), 3)
        return {i: every[64 * k : 64 * k + 64] for k, i in enumerate(sorted(images))}
    if method == "hsvt_pca":
        return {i: standard_components(hsv_and_thermal(p)) for i, p in images.items()}
    return {i: factors(p.reshape(64, 4)) for i, p in images.items()}  # a patch is larger than these images


@pytest.mark.parametrize("method", ["pca_full", "hsvt_pca", "fa", "fa_patches"])
def test_fitted_fusions(spark, images, method):
    got = PLANS[f"p_{method}"][0](spark, SF).toPandas().set_index("image_id")
    assert set(got.index) == set(images)
    place = np.arange(64)[:, None]
    for i, rows in fitted(images, method).items():
        c = norm255(rows)
        assert got.loc[i, "n"] == 64
        assert np.abs(got.loc[i, ["s0", "s1", "s2"]].to_numpy(float) - c.sum(axis=0)).max() <= 2, (i, got.loc[i], c.sum(axis=0))
        assert np.abs(got.loc[i, ["w0", "w1", "w2"]].to_numpy(float) - (c * place).sum(axis=0)).max() <= 126


def test_component_scores_of_rows(spark):
    rows = pd.read_parquet(f"{SF}/lineitem.parquet")
    x = rows[["l_quantity", "l_extendedprice", "l_discount", "l_tax"]].astype(float)
    z = ((x - x.mean()) / x.std()).to_numpy()
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    pc = z @ (vt[:3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])[:, None]).T
    want = pd.DataFrame(pc, columns=["PC1", "PC2", "PC3"]).groupby(rows["l_returnflag"]).agg(["mean", "std"])
    got = PLANS["d15_pca_scores"][0](spark, SF).toPandas().set_index("l_returnflag")
    assert set(got.index) == set(want.index)
    for flag in want.index:
        for c in ("PC1", "PC2", "PC3"):
            for s in ("mean", "std"):
                assert got.loc[flag, f"{c}_{s}"] == pytest.approx(want.loc[flag, (c, s)], abs=1e-5), (flag, c, s)


def test_whole_evaluation(spark, scored, images):
    """Means over the evaluation images of the scores as made above; shares at the ends of the calibration."""
    from duolume.operators.sampling import split_calibration

    ids = spark.createDataFrame([(i,) for i in images], "image_id long")
    seen = [x["image_id"] for x in split_calibration(ids, "image_id", "q22", ratio=0.2).filter("part = 'evaluation'").collect()]
    assert 0 < len(seen) < len(images)
    got = PLANS["q22_evaluate"][0](spark, SF).toPandas().set_index("method")
    assert set(got.index) == {"rgbt", "rgbt_v2", "visible", "lwir", "hsvt", "wavelet", "pca"} and (got["n"] == len(seen)).all()
    for method in ("rgbt", "rgbt_v2", "visible", "lwir"):
        of = {"grad": [], "freq": [], "mi": [], "ssim": []}
        for i in seen:
            v, t, f = scored[method, i]
            of["grad"].append(score_grad(v, t, f))
            of["freq"].append(score_freq(v, t, f))
            turned = [f[..., list(p)] for _, p in kept_orders(v, f)]
            of["mi"].append(np.mean([score_mi(v, t, x) for x in turned]))
            of["ssim"].append(np.mean([score_ssim(v, t, x) for x in turned]))
        for name, values in of.items():
            assert got.loc[method, f"{name}_mean"] == pytest.approx(np.mean(values), abs=2e-3), (method, name)
            assert got.loc[method, f"{name}_std"] == pytest.approx(np.std(values), abs=2e-3), (method, name)
    assert got["latent_z_mean"].between(0, 1).all()
    assert got["latent_z_mean"].idxmax() == "lwir" and got["latent_z_mean"].idxmin() == "visible"
    assert (got["thermal_share_reg"] + got["reg_mean"] / 100 - 1).abs().max() < 1e-9
