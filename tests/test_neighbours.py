"""Nearest neighbours of all rows against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from duolume.operators.neighbours import nearest_neighbours, neighbours_kept

SF = "/root/testdata/sf0.001"


def all_nearest(ids, x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return {ids[i]: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (round(d[i, j], 12), ids[j]))[:k]] for i in range(len(ids))}


def found(df):
    out = {}
    for x in sorted(map(tuple, df.collect()), key=lambda x: (x[0], x[2])):
        out.setdefault(x[0], []).append(x[1])
    return out


@pytest.fixture(scope="module")
def clustered():
    """Groups in space, some equal vectors, one far away."""
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(0, 0.2, (60, 8)) for c in rng.normal(0, 5, (12, 8))])
    x[100:130] = x[100]
    x[5] = 400.0
    return np.round(x, 6)


def frame(spark, x):
    return spark.createDataFrame([(int(i) * 3, v.tolist()) for i, v in enumerate(x)] + [(1, None)], "id long, vec array<double>").repartition(5)


@pytest.mark.parametrize(("k", "centres"), [(1, None), (5, None), (10, 3), (40, 200)])
def test_neighbours_equal_those_of_all_pairs(spark, clustered, k, centres):
    df, pairs = nearest_neighbours(frame(spark, clustered), "id", "vec", k, centres)
    assert found(df) == all_nearest([3 * i for i in range(len(clustered))], clustered, k)
    if centres is None:
        n = len(clustered)
        assert pairs.count() < n * n / 5


def test_equal_vectors_and_few_rows(spark):
    x = np.zeros((300, 2))
    assert found(nearest_neighbours(frame(spark, x), "id", "vec", 4)[0]) == {3 * i: [0, 3, 6, 9] for i in range(300)}
    df, pairs = nearest_neighbours(frame(spark, np.array([[1.0], [2.0]])), "id", "vec", 5)
    assert found(df) == {0: [0, 3], 3: [3, 0]} and pairs.count() == 4
    assert nearest_neighbours(frame(spark, x).limit(0), "id", "vec", 5)[0].collect() == []


def test_kept_neighbours(spark, clustered):
    from pyspark.sql import functions as F

    df = frame(spark, clustered).withColumn("part", F.slice("vec", 1, 3))
    ids = [3 * i for i in range(len(clustered))]
    a, b = all_nearest(ids, clustered, 10), all_nearest(ids, clustered[:, :3], 10)
    assert {x["q"]: round(x["kept"], 6) for x in neighbours_kept(df, "id", "vec", "part").collect()} == {i: round(len(set(a[i]) & set(b[i])) / 10, 6) for i in ids}
