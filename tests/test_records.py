"""Small cases of the record operators: nulls, edges, ties, empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom.operators import records


def test_symbols(spark):
    typed = {"SH600000": "sh600000", "600000": "sh600000", "000001": "sz000001", " hk 00700": "hk00700", "00700": "hk00700", "usAAPL": "usaapl", "aapl": "usaapl", "us^gspc": "us^gspc", "fxusdcnh": "fxusdcnh", "Com Gold": "comgold", "hkhsi": "hkhsi", "?": None, "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in typed], "value string").select("value", records.normal_symbol(F.col("value")).alias("symbol"))
    rows = rows.select("value", "symbol", records.security_id(F.col("symbol")).alias("id"), records.benchmark_of(F.col("symbol")).alias("bench"))
    got = {r["value"]: r for r in rows.collect()}
    assert {k: r["symbol"] for k, r in got.items()} == typed
    assert [got[k]["id"] for k in ("SH600000", "000001", "00700", "aapl", "us^gspc", "?")] == ["1.600000", "0.000001", "116.00700", "105.AAPL", None, None]
    assert [got[k]["bench"] for k in ("SH600000", "00700", "aapl", None)] == ["sh000300", "hkhsi", "usspy", "sh000300"]


def test_conditions(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    cases = [({"gte": 2}, [2.0]), ({"gt": 2}, []), ({"lte": 1}, [1.0]), ({"lt": 2}, [1.0]), ({"eq": 1.0}, [1.0]), ({"ne": 1.0}, [2.0, None]), ({"in": [1.0, None]}, [1.0, None]), ({"exists": False}, [None]), ({"any_of": [{"lt": 2}, {"exists": False}]}, [1.0, None]), ({}, [1.0, 2.0, None]), (2.0, [2.0])]
    for wanted, left in cases:
        got = [r["x"] for r in rows.where(records.condition(F.col("x"), wanted)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, left)), wanted


def test_page_runs(spark):
    pages = [("a", p) for p in (1, 2, 3, 4, 5, 5, 9)] + [("b", 7)]
    runs = records.page_runs(spark.createDataFrame(pages, "k string, p long"), "k", "p")
    assert sorted(map(tuple, runs.collect())) == [("a", 1, 4, 4), ("a", 5, 5, 1), ("a", 9, 9, 1), ("b", 7, 7, 1)]
    assert records.page_runs(spark.createDataFrame([], "k string, p long"), "k", "p").count() == 0


def test_latest_disclosed_does_not_look_ahead(spark):
    d = dt.date
    rows = [("a", d(2020, 3, 31), d(2020, 4, 30), 1.0), ("a", d(2020, 6, 30), d(2020, 8, 30), 2.0), ("b", d(2018, 3, 31), d(2018, 4, 30), 3.0), ("c", d(2020, 3, 31), d(2020, 4, 30), None)]
    out = records.latest_disclosed(spark.createDataFrame(rows, "key string, stat_date date, pub_date date, value double"), "2020-08-01")
    assert [tuple(r) for r in out.collect()] == [rows[0]]


def test_consensus_and_major_parts(spark):
    votes = spark.createDataFrame([("k", "bullish", 0.9, 1.0), ("k", "bearish", 0.5, 0.2), ("k", "bearish", 0.4, 1.0), ("z", "neutral", 0.5, 0.0)], "key string, direction string, similarity double, quality double")
    got = {r["key"]: (r["direction"], round(r["strength"], 6), r["supporting"]) for r in records.consensus(votes).collect()}
    assert got == {"k": ("bullish", 0.9, 2), "z": ("neutral", 0.0, 1)}
    parts = spark.createDataFrame([("k", n, v) for n, v in (("a", -6.0), ("b", 3.0), ("c", 1.0))] + [("m", n, 1.0) for n in "abcdefgh"], "key string, name string, value double")
    got = sorted((r["key"], r["name"]) for r in records.major_parts(parts, "key", "name", "value").collect())
    assert got == [("k", "a"), ("m", "a"), ("m", "b"), ("m", "c")]
