"""Every query with an oracle gives the oracle's rows on the smallest tables; the others give a stable schema."""

import math
import os

import duckdb
import pytest

from pulselake.plans.oracles import ORACLES
from pulselake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") if abs(v) > 1e-9 else 0.0
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.6g}")
    return v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        if os.path.exists(f"{SF}/{name}.parquet"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = sql.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0
