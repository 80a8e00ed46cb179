"""The keyed store: nothing is computed twice, crashes lose nothing, changed fingerprints recompute one method only."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolume.operators import calibration as C
from duolume.operators.incremental import KEY, KeyedStore, cache_key, fingerprint
from duolume.plans.views import pixels

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), "name string, value double")


def wanted(spark, names, mark="a"):
    return spark.createDataFrame([(x,) for x in names], "name string").select(cache_key(mark, F.col("name")).alias(KEY), "name")


def test_only_missing_rows_are_computed(spark, store):
    asked = []

    def compute(todo):
        asked.append(sorted(x["name"] or "" for x in todo.collect()))
        return todo.withColumn("value", F.length("name").cast("double"))

    assert store.batches() == [] and store.rows().count() == 0
    assert store.complete(wanted(spark, ["a", "bb", None]), compute).count() == 3
    assert store.complete(wanted(spark, ["a", "bb", "ccc", None]), compute).count() == 4
    assert store.complete(wanted(spark, ["a", "bb", "ccc"]), compute).count() == 3
    assert asked == [["", "a", "bb"], ["ccc"]]
    assert store.complete(wanted(spark, ["a"], "b"), compute).count() == 1 and asked[2:] == [["a"]]
    assert len(store.batches()) == 3 and store.rows().count() == 5
    rows = {x["name"] or "": x["batch"] for x in store.rows(batch=True).filter("name <> 'a' or name is null").collect()}
    assert rows == {"bb": 1, "": 1, "ccc": 2}


def test_a_batch_without_commit_does_not_count(spark, store, monkeypatch):
    rows = wanted(spark, ["a"]).withColumn("value", F.lit(1.0))
    monkeypatch.setattr(KeyedStore, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.append(rows)
    monkeypatch.undo()
    assert len(os.listdir(f"{store.path}/batches")) == 1 and store.rows().count() == 0
    assert store.complete(wanted(spark, ["a"]), lambda x: x.withColumn("value", F.lit(2.0))).first()["value"] == 2.0


def test_compaction_keeps_rows(spark, store):
    for name in "abc":
        store.append(wanted(spark, [name]).withColumn("value", F.lit(1.0)))
    before = sorted(map(tuple, store.rows().collect()))
    store.compact(2)
    assert len(store.batches()) == 1 and sorted(map(tuple, store.rows().collect())) == before
    store.append(wanted(spark, ["d"]).withColumn("value", F.lit(1.0)))
    assert store.rows().count() == 4 and len(store.batches()) == 2


def test_keys_and_fingerprints(spark):
    row = spark.range(1).select(*[cache_key(*x).alias(str(k)) for k, x in enumerate([("a", "b"), ("ab", ""), ("a|b",), ("a", F.lit(None).cast("string")), ("a", "-")])]).first()
    assert len(set(row)) == 5
    assert fingerprint(wanted) != fingerprint(test_keys_and_fingerprints) and len(fingerprint(len)) == 64


def test_variants_end_to_end(spark):
    """A variant's row equals its own calibration and evaluation; anchors are apart, and the share of the mean is on the aggregate curve."""
    from duolume.operators import pixels as P

    px = pixels(spark, SF).filter("image_id < 10")
    parts = px.select("image_id").distinct().withColumn("part", F.when(F.col("image_id") < 3, "calibration").otherwise("evaluation"))
    names, alphas = ["reg", "spectral"], [0.0, 0.5, 1.0]
    got = {(x["variant"], x["method"]): x for x in C.evaluate_variants(px, parts, ["rgbt", "visible", "lwir"], {"plain": ("none", "none", lambda x: x), "eq": ("none", "expand", P.equalize_expand)}, alphas, names).collect()}
    assert set(got) == {(v, m) for v in ("plain", "eq") for m in ("rgbt", "visible", "lwir")} and {x["eq_th"] for x in got.values()} == {"none", "expand"}
    for variant, own in (("plain", px), ("eq", P.equalize_expand(px))):
        knots, weights = C.calibrate(own.filter("image_id < 3"), alphas, names)
        seen = own.filter("image_id >= 3")
        rows = C.evaluate(seen, P.fuse_all(seen, ["rgbt"]), knots, weights, names).collect()
        x = got[variant, "rgbt"]
        assert x["n"] == len(rows) == 7
        for c in ("reg", "robust", "latent_z"):
            assert abs(x[f"{c}_mean"] - sum(r[c] for r in rows) / 7) < 1e-9
        curve = knots.filter("proxy = 'aggregate' and stype = 'blend'").first()["knots"]
        at = float(np.interp(x["robust_mean"], [k["knot_x"] for k in curve], [k["knot_y"] for k in curve]))
        assert abs(x["latent_z_of_mean"] - (1 - at)) < 1e-9 and abs(x["cont_vis_calibrated"] - 100 * at) < 1e-7
        assert got[variant, "visible"]["latent_z_of_mean"] < x["latent_z_of_mean"] < got[variant, "lwir"]["latent_z_of_mean"]


def test_scores_and_latent_shares_from_the_store(spark, tmp_path):
    """Stored scores give the same latent shares as a store that was empty; calibration may change without computing scores again."""
    px = pixels(spark, SF).filter("image_id < 6")
    images = px.select("image_id", F.lit(1.0).alias("visible_time"), F.lit(None).cast("double").alias("thermal_time")).distinct()
    knots, weights = C.calibrate(px, [0.0, 0.5, 1.0], ["reg", "spectral"])
    asked = C.wanted_scores(images, {"rgbt": "x", "visible": "y"}, "none")
    store, fresh = C.score_store(spark, str(tmp_path / "a")), C.score_store(spark, str(tmp_path / "b"))
    C.incremental_scores(store, px, asked.filter("image_id % 3 = 0"), ["reg", "spectral"])
    both = [sorted((x["method"], x["image_id"], round(x["latent_z"], 9), x["by_aggregate"]) for x in C.evaluate_incremental(s, px, asked, knots, weights, ["reg", "spectral"]).collect()) for s in (store, fresh)]
    assert both[0] == both[1] and len(both[0]) == 12 and len(store.batches()) == 2 and len(fresh.batches()) == 1
    assert store.missing(asked).count() == 0
    later = C.wanted_scores(images.withColumn("visible_time", F.when(F.col("image_id") == 1, 9.0).otherwise(F.col("visible_time"))), {"rgbt": "x", "visible": "y"}, "none")
    assert sorted(set(x["image_id"] for x in store.missing(later).collect())) == [1]
