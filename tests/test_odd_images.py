"""Images without spread, and images that lack a channel."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from duolume.operators import pixels as P
from duolume.operators import scores as S
from duolume.plans import views
from duolume.sources import annotations as A


def plane(image, channels):
    """Rows of an 8 x 8 image; a channel is a function of y and x, or None."""
    return [(image, y, x, *[None if f is None else float(f(y, x)) for f in channels]) for y in range(8) for x in range(8)]


RAMP, STEP, FLAT = (lambda y, x: 8 * y + x), (lambda y, x: (y * x * 7) % 200), (lambda y, x: 40)


@pytest.fixture(scope="module")
def odd(spark):
    rows = plane(0, [RAMP, STEP, STEP, RAMP]) + plane(1, [FLAT] * 4) + plane(2, [RAMP, FLAT, STEP, RAMP]) + plane(3, [RAMP, STEP, None, None])
    return spark.createDataFrame(rows, "image_id long, y long, x long, b double, g double, r double, t double").persist()


def test_correlation_without_spread_or_values(odd):
    """`corr` fails on a constant column under ANSI rules, whatever condition is around it."""
    got = {x["image_id"]: x for x in odd.groupBy("image_id").agg(S.corr0("b", "g").alias("bg"), S.corr0("b", "t").alias("bt"), S.corr0("g", "r").alias("gr")).collect()}
    want = odd.toPandas().groupby("image_id")[["b", "g"]].corr().unstack()["b"]["g"]
    assert [got[k]["bg"] for k in (1, 2)] == [0, 0]
    assert abs(got[0]["bg"] - want[0]) < 1e-12 and abs(got[0]["bt"] - 1) < 1e-12
    assert got[3]["bt"] is None and got[3]["gr"] is None


def test_redundancy_of_flat_tiles(odd):
    table = odd.filter("image_id < 3").select(F.lit("m").alias("method"), "image_id", "y", "x", *[F.col(c).alias(f"f{i}") for i, c in enumerate("bgr")])
    got: pd.DataFrame = S.channel_redundancy(table).toPandas().set_index("image_id")
    assert got.loc[1, "pearson"] == 0 and got.loc[1, "tiles"] == 0 and got.loc[1, "rank"] == 1
    assert got.loc[2, "redundancy"] < got.loc[0, "redundancy"] <= 1


def test_an_image_that_lacks_channels_stays(spark, tmp_path):
    """The last image has two vectors of four; nothing of it is left out or made up."""
    vectors = spark.createDataFrame([(k, [0.01 * ((k * 13 + j) % 50) for j in range(64)], 0) for k in range(6)], "vec_id long, embedding array<float>, label int")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    px = views.pixels(spark, str(tmp_path)).persist()
    last = px.filter("image_id = 1").toPandas()
    assert len(last) == 64 and last["b"].notna().all() and last["g"].notna().all() and last["r"].isna().all() and last["t"].isna().all()
    fused = {x["image_id"]: x["c"] for x in P.fuse(px, "rgbt").filter("y = 0 and x = 0").collect()}
    assert fused[1] == [None] * 3 and None not in fused[0]
    hist = P.histograms(px)
    assert hist.groupBy("image_id", "channel").count().count() == 8
    assert {x["channel"]: math.isnan(x["mean"]) for x in P.hist_metrics(hist).collect()} == {"b": False, "g": False, "r": True, "t": True}
    got = {(x["channel"], x["bin"]): x["mean"] for x in P.hist_envelope(hist).collect()}
    assert abs(sum(v for (c, _), v in got.items() if c == "t") - 50) < 1e-9 and abs(sum(v for (c, _), v in got.items() if c == "b") - 100) < 1e-9


def test_missing_values_of_stored_images(odd):
    back = A.to_pixels(A.pack_images(odd), F.col("image.origin")).orderBy("image_id", "y", "x").toPandas()
    want = odd.orderBy("image_id", "y", "x").toPandas()
    for c in "bgr":
        assert back[c].equals(want[c])
