"""Every query with an oracle gives the oracle's rows; the others run."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e
from tickloom.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    out = pd.DataFrame()
    for c in df.columns:
        s = df[c]
        if str(s.dtype).startswith(("datetime", "date")):
            s = pd.to_datetime(s).astype(str)
        elif s.dtype == object and len(s) and hasattr(s.dropna().iloc[0] if s.notna().any() else "", "isoformat"):
            s = pd.to_datetime(s).astype(str)
        elif s.dtype.kind in "if":
            s = s.astype(float).round(4) + 0.0
        out[c] = s.astype(object).where(s.notna(), None)
    return out.sort_values(list(out.columns), key=lambda s: s.astype(str), ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got = canonical(QUERIES[name](spark, SF).toPandas())
    want = canonical(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) and len(got) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-4, rtol=1e-6)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert QUERIES.keys() <= e.queries().keys() and ORACLES.keys() <= e.oracle_sql().keys()
