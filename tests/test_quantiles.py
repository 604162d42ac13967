"""Sliding quantiles against ``F.percentile``, over blocks smaller than the histories and with missing values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.quantiles import Ask, with_quantiles
from tickloom.functions.rolling import ordered
from tickloom.operators import candles, judged
from tickloom.operators.bars import build
from tickloom.sources.bars import supplier_walk

ASKS = {"a": Ask("x", 0.8, 20, 5), "b": Ask("x", 0.5, 7, 3), "c": Ask("y", 0.25, 31, 10, 1), "d": Ask("y", 0.75, 31, 10, 1), "e": Ask("y", 0.3, 1, 1, 2)}


@pytest.mark.parametrize("block", [1, 40, 1024])
def test_against_percentile(spark, block):
    rng = random.Random(5)
    value = lambda: rng.choice([None, float("nan"), 0.0, float("inf")]) if rng.random() < 0.2 else rng.gauss(0, 1)
    rows = spark.createDataFrame([(s, i * 3, value(), value()) for s, n in (("one", 200), ("two", 1), (None, 33)) for i in range(n)], "symbol string, ts int, x double, y double")
    frame = lambda a: ordered().rowsBetween(-(a.n - 1) - a.back, -a.back)
    want = rows.select("symbol", "ts", *[F.when(F.count(a.of).over(frame(a)) >= a.least, F.percentile(a.of, a.share).over(frame(a))).alias(n) for n, a in ASKS.items()])
    found = with_quantiles(rows, ASKS, block).select(*want.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_no_percentile_slides_over_bars(spark):
    bars = build(supplier_walk(spark, "/root/testdata/sf0.001"))
    plan = candles.components(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" in plan and "percentile" not in "".join(x for x in plan.splitlines() if "specifiedwindowframe(RowFrame, -" in x and "unboundedfollowing" not in x)


def test_last_bars_alone(spark):
    bars = build(supplier_walk(spark, "/root/testdata/sf0.001")).cache()
    all_, last = (judged.from_candles(bars, n) for n in (None, 50))
    ends = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    want = all_.join(ends, "symbol").where("end >= n - 50").select(*judged.FIELDS)
    assert want.count() > 0 and sorted(map(str, last.select(*judged.FIELDS).collect())) == sorted(map(str, want.collect()))
