"""Stated queries against all rows by pairs of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from duolume.operators import tables
from duolume.operators.neighbours import blockwise
from duolume.operators.stats import knn_preservation


def vectors(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(230, 6)), 1)
    v[100:130] = v[:30]  # copies: ties go by id
    rows = [(7 * k - 300, x.tolist(), x[:2].tolist()) for k, x in enumerate(v)]
    return spark.createDataFrame([*rows, (9_999, None, None)], "id long, full array<double>, part array<double>"), [x[0] for x in rows], v


def test_blocks_meet_each_pair_once_and_in_order(spark):
    df, ids, v = vectors(spark)
    give = lambda q, own, d: (pa.array([q]), pa.array([own.tolist()], pa.list_(pa.int64())), pa.array([d.tolist()], pa.list_(pa.float64())))
    got = blockwise(df, F.col("id") % 2 == 0, "id", ["full"], 50, 9, give, "q long, ids array<long>, d array<double>").collect()
    asked = [i for i in ids if i % 2 == 0]
    assert len(got) == 5 * len(asked) and all(x["ids"] == sorted(x["ids"]) and len(x["ids"]) <= 50 for x in got)
    for q in asked:
        found = {i: y for x in got if x["q"] == q for i, y in zip(x["ids"], x["d"], strict=True)}
        want = ((v - v[ids.index(q)]) ** 2).sum(axis=1)
        assert sorted(found) == sorted(ids) and all(abs(found[i] - y) < 1e-9 for i, y in zip(ids, want, strict=True))


def test_preservation_equals_brute_force(spark, monkeypatch):
    df, ids, v = vectors(spark)
    distance = lambda x, q: ((x - x[ids.index(q)]) ** 2).cumsum(axis=1)[:, -1]
    near = lambda x, q: set(np.argsort(distance(x, q), kind="stable")[:10])
    kept = {x["q"]: x["kept"] for x in knn_preservation(df, "id", "full", "part", F.col("id") % 10 == 0).collect()}
    asked = [i for i in ids if i % 10 == 0]
    assert kept == {q: len(near(v, q) & near(v[:, :2], q)) / 10 for q in asked}
    for most in (tables.MOST_RANKED, 10):
        monkeypatch.setattr(tables, "MOST_RANKED", most)
        got = {x["anchor"]: x["spearman"] for x in tables.distance_preservation(df.filter("full is not null"), "id", "full", "part", F.col("id") % 10 == 0).collect()}
        assert sorted(got) == sorted(asked)
        for q in asked:
            other = np.array(ids) != q
            ranks = [np.argsort(np.argsort(distance(x, q)[other], kind="stable")) for x in (v, v[:, :2])]
            assert abs(got[q] - np.corrcoef(*ranks)[0, 1]) < 1e-9
