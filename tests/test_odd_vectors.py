"""Pixel queries on vectors with missing, repeated and constant values give the rows of their SQL."""

from __future__ import annotations

import math
import random

import duckdb
import pytest

from duolume.plans.registry import plans

NAN = float("nan")
PLANS = plans()


def vectors():
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-0.7, 0.7) for _ in range(64)]) for k in range(24)]
    rows += [(8, rows[1][1]), (11, rows[2][1])]  # repeated ids
    rows += [(24, None), (25, []), (26, rows[3][1][:60]), (27, [None, NAN, *rows[4][1][2:]])]
    return rows + [(28, rows[5][1]), (29, None), (30, [0.1] * 64)]  # flat channels, and none


def flat():
    return [(k, [0.1] * 64) for k in range(32, 36)] + [(k, vectors()[k][1] if k < 3 else [0.1] * 64) for k in range(4)]


def rows_of(spark, tmp_path, name, rows):
    spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    query, sql = PLANS[name]
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = query(spark, str(tmp_path)), duck.sql(sql)
    return tidy(got.select(*want.columns).collect()), tidy(want.fetchall())


def tidy(rows):
    whole = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 4) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(whole, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["d30_hist_envelope", "d30_hist_metrics", "d31_hist_density", "d32_contrast_sharpness", "e10_box_stats", "e11_blur", "e9_sobel", "p16_wavelet", "p19_sobel_weighted"])
def test_odd_vectors(spark, tmp_path, name):
    got, want = rows_of(spark, tmp_path, name, vectors())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 2e-4) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", ["p16_wavelet", "p19_sobel_weighted", "p26_fuse_all"])
def test_images_without_range(spark, tmp_path, name):
    got, want = rows_of(spark, tmp_path, name, flat())
    assert got == want and "nan" in str(got)
