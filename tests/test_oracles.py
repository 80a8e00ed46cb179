"""Every registered query with SQL gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from duolume.plans.registry import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = plans()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(4) + 0.0
    df = df.sort_values(list(df.columns)).reset_index(drop=True).astype(object)
    return df.where(df.notna(), None)


@pytest.mark.parametrize("name", [n for n, (_, sql) in PLANS.items() if sql])
def test_same_rows(spark, duck, name):
    query, sql = PLANS[name]
    got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b)
    for c in a.columns:
        for x, y in zip(a[c], b[c], strict=True):
            assert x == y or (isinstance(x, (float, np.floating)) and abs(x - y) < 2e-4), (c, x, y)


# the whole evaluation runs in test_values
@pytest.mark.parametrize("name", [n for n, (_, sql) in PLANS.items() if not sql and n != "q22_evaluate"])
def test_runs(spark, name):
    assert PLANS[name][0](spark, SF).count() > 0
