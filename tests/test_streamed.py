"""Stated queries against all rows as a stream: no pair is shuffled or written."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duolume.operators import neighbours
from duolume.operators.neighbours import against_all
from duolume.operators.tables import distance_preservation


def vectors(spark, more=()):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(700, 5)), 1)
    v[300:400] = v[:100]  # copies: ties go by id
    rows = [(3 * k - 500, x.tolist(), x[:2].tolist()) for k, x in enumerate(v)]
    rng.shuffle(order := list(range(700)))
    df = spark.createDataFrame([*[rows[k] for k in order], (None, v[0].tolist(), v[0][:2].tolist()), (10_000, None, None), *more], "id long, full array<double>, part array<double>")
    return df.repartition(5), np.array([x[0] for x in rows]), v


@pytest.mark.parametrize("held", [1, neighbours.HELD])
def test_each_query_meets_all_rows_in_the_order_of_ids(spark, monkeypatch, held):
    monkeypatch.setattr(neighbours, "HELD", held)
    monkeypatch.setattr(neighbours, "_PACKED", 9)
    df, ids, v = vectors(spark, [(-500, [9.0] * 5, [9.0] * 2)])
    give = lambda q, own, full, part: (pa.array([q]), *[pa.array([x.tolist()], pa.list_(t)) for x, t in ((own, pa.int64()), (full, pa.float64()), (part, pa.float64()))])
    got = against_all(df, F.col("id") % 10 == 0, "id", ["full", "part"], give, "q long, ids array<long>, df array<double>, dp array<double>").collect()
    assert sorted(x["q"] for x in got) == sorted(i for i in ids.tolist() if i % 10 == 0)
    for x in got:
        twice = x["q"] == -500  # two rows of this id, which both are asked
        assert x["ids"] == sorted([*ids.tolist(), -500] * (1 + twice))
        if not twice:
            one = v[ids.tolist().index(x["q"])]
            for d, k in (("df", 5), ("dp", 2)):
                assert np.abs(np.array(x[d])[2:] - ((v - one)[1:, :k] ** 2).cumsum(axis=1)[:, -1]).max() < 1e-12


def test_ranks_of_distances_shuffle_no_pairs(spark):
    df, ids, v = vectors(spark)
    found = distance_preservation(df, "id", "full", "part", F.col("id") % 10 == 0)
    assert "hashpartitioning(anchor" not in found._jdf.queryExecution().toString()
    got = {x["anchor"]: x["spearman"] for x in found.collect()}
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 10 == 0)
    for q, y in got.items():
        other = ids != q
        ranks = [np.argsort(np.argsort(((v - v[ids.tolist().index(q)])[other][:, :k] ** 2).cumsum(axis=1)[:, -1], kind="stable")) for k in (5, 2)]
        assert abs(y - np.corrcoef(*ranks)[0, 1]) < 1e-9


def test_no_queries_and_one_row(spark):
    df = vectors(spark)[0]
    assert distance_preservation(df, "id", "full", "part", F.col("id") == 2).collect() == []
    assert distance_preservation(df.filter("id = -500"), "id", "full", "part", F.lit(True)).collect() == []
