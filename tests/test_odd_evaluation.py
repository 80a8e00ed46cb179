"""Evaluations over images that lack channels: a proxy without a value has no part in the shares, and no image goes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from duolume.operators import calibration as C
from duolume.operators import pixels as P
from duolume.operators.sampling import split_calibration
from duolume.operators.scores import aggregate_proxies
from duolume.operators.stats import interp_column
from duolume.plans.registry import plans

CURVE = "array(struct(0.0D AS knot_x, 0.0D AS knot_y), struct(100.0D AS knot_x, 1.0D AS knot_y))"


def test_interpolation_of_nothing(spark):
    rows = spark.createDataFrame([(None,), (-1.0,), (25.0,), (100.0,)], "x double")
    none = F.filter(F.expr(CURVE), lambda k: k["knot_x"] > 200)
    got = rows.select(interp_column(F.expr(CURVE), F.col("x")).alias("v"), interp_column(none, F.col("x")).alias("none")).collect()
    assert [x["v"] for x in got] == [None, 0, 0.25, 1] and all(x["none"] is None for x in got)


def test_robust_mean_of_nothing(spark):
    rows = spark.createDataFrame([(0, None), (0, None), (1, 40.0), (1, None)], "k int, value double")
    assert {x["k"]: x["robust"] for x in aggregate_proxies(rows, ["k"]).collect()} == {0: None, 1: 40}


def test_shares_by_the_proxies_that_have_a_value(spark):
    rng = random.Random(2)
    rows = [(i, y, x, *[float(rng.randrange(256)) for _ in "bgr"], float(rng.randrange(256)) if i < 2 else None) for i in range(4) for y in range(8) for x in range(8)]
    px = spark.createDataFrame(rows, "image_id long, y long, x long, b double, g double, r double, t double")
    each = spark.createDataFrame([("blend", "reg"), ("blend", "spectral")], "stype string, proxy string")
    curve = F.expr("array(struct(0.0D AS knot_x, 0.1D AS knot_y), struct(1.0D AS knot_x, 0.1D AS knot_y))")
    got = C.evaluate(px, P.fuse_all(px, ["rgbt", "visible"]), each.withColumn("knots", F.expr(CURVE)), each.withColumns({"w": F.lit(0.5), "sigmas": curve}), ["reg", "spectral"]).toPandas()
    assert len(got) == 8
    for x in got.to_dict("records"):
        lacks = x["image_id"] > 1 and x["method"] == "rgbt"
        assert (x["spectral"] != x["spectral"]) == lacks
        want = 1 - x["reg"] / 100 if lacks else 1 - (x["reg"] + x["spectral"]) / 200
        assert x["latent_z"] == pytest.approx(want) and x["latent_z_alpha_dep"] == pytest.approx(want)


def vectors():
    rng = random.Random(5)
    one = lambda n=64: [rng.uniform(-0.55, 0.55) for _ in range(n)]
    rows = [(k, one()) for k in range(40)]
    rows += [(4 * i + c, one()) for i in range(10, 20) for c in range(4) if i % 3 + 1 > c]  # one to three channels
    return [*rows, (80, None), (81, one(60)), (82, [None, float("nan"), *one(62)]), (83, one(70)), (None, one()), (-5, one()), (3, one())]


@pytest.mark.parametrize("name", ["q22_evaluate", "q22_variants"])
def test_images_that_lack_channels(spark, tmp_path, name):
    spark.createDataFrame([(k, v, 0) for k, v in vectors()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    ids = spark.createDataFrame([(i,) for i in range(-1, 21)], "image_id long")
    seen = split_calibration(ids, "image_id", "q22", ratio=0.2).filter("part = 'evaluation'").count()
    got = plans()[name][0](spark, str(tmp_path)).toPandas()
    if "variant" in got:
        got = got[got["variant"] == "plain"]
    assert len(got) == (7 if name == "q22_evaluate" else 3) and (got["n"] == seen).all()
    assert got["latent_z_mean"].between(0, 1).all() and got["reg_mean"].between(0, 100).all()
    share = got.set_index("method")["latent_z_mean"]
    assert share["lwir"] > share["rgbt"] > share["visible"]
