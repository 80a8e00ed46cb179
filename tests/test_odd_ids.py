"""Pixel queries on ids that are null, below 0 or beyond 2^53, and on vectors of more than 64 numbers, give the rows of their SQL."""

from __future__ import annotations

import random

import pytest
from test_odd_vectors import rows_of

QUERIES = ["d30_hist_metrics", "d31_hist_density", "d32_contrast_sharpness", "e10_box_stats", "e11_blur"]


def rows(ids, n=64):
    rng = random.Random(7)
    return [(k, [rng.uniform(-0.5, 0.5) for _ in range(64)]) for k in range(12)] + [(k, [rng.uniform(-0.5, 0.5) for _ in range(n)]) for k in ids]


TABLES = {
    "null": rows([None, None]),
    "below_0": rows(range(-9, 0)),
    "huge": rows(range(2**53 + 1, 2**53 + 9)),
    "long": rows(range(12, 16), 70),
    "long_below_0": rows([-1, -4, -5], 66),
}


@pytest.mark.parametrize("kind", TABLES)
@pytest.mark.parametrize("name", QUERIES)
def test_odd_ids(spark, tmp_path, name, kind):
    got, want = rows_of(spark, tmp_path, name, TABLES[kind])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 2e-4) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", ["d30_hist_envelope", "e9_sobel", "p16_wavelet", "p19_sobel_weighted", "p_rgbt", "p_ssim"])
def test_a_pixel_without_a_place(spark, tmp_path, name):
    got, want = rows_of(spark, tmp_path, name, TABLES["long"])
    assert got == want


def test_metrics_without_brightness(spark, tmp_path):
    got, want = rows_of(spark, tmp_path, "d30_hist_metrics", [(k, [-0.7] * 64) for k in range(4)])
    assert got == want and str(got).count("nan") == 4
