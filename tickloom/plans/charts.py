"""Queries of chart structures, over weekly walks of suppliers and daily bars of line items.

No SQL expresses the rules in a text of sensible length; ``tests/test_charts.py``
holds them against plain loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars, charts, judged, resolution, swings
from ..sources import bars as sources
from .registry import query

FLAT = ("symbol", "end_idx", "length", "pattern", "family", "direction", "confidence", "start", "end", "confirmed", "false_break", "level", "height")


def walks(spark, d) -> DataFrame:
    return bars.build(sources.supplier_walk(spark, d))


def listed(signals: DataFrame) -> DataFrame:
    """Signals as plain columns, with their pivots and lines counted."""
    return signals.select(*FLAT, F.size("pivots").alias("pivots"), F.size("lines").alias("lines"), F.size("arcs").alias("arcs"))


@query("chart_swings")
def chart_swings(spark, d):
    return swings.swings(walks(spark, d))


@query("chart_multiple_extremes")
def chart_multiple_extremes(spark, d):
    return listed(charts.detect(walks(spark, d), daily=False, rules=("multiple",)))


@query("chart_heads_and_shoulders")
def chart_heads_and_shoulders(spark, d):
    return listed(charts.detect(walks(spark, d), daily=False, rules=("heads",), step=52))


@query("chart_turns")
def chart_turns(spark, d):
    return listed(charts.detect(walks(spark, d), daily=False, rules=("turns",)))


@query("chart_cups_and_bases")
def chart_cups_and_bases(spark, d):
    return listed(charts.detect(walks(spark, d), daily=False, rules=("cups",)))


@query("chart_consolidations")
def chart_consolidations(spark, d):
    return listed(charts.detect(walks(spark, d), daily=False, rules=("bounded",)))


@query("judged_signals")
def judged_signals(spark, d):
    """Candlesticks and chart structures of suppliers' walks, gated, and the verdict of each symbol."""
    verdicts, _ = judged.judge(walks(spark, d))
    return verdicts.withColumn("rules", F.array_join("rules", ", "))


@query("signal_roles")
def signal_roles(spark, d):
    """The candlesticks alone, judged: every signal with its score and role."""
    signals = judged.candles_of(walks(spark, d), "weekly").where("size(reasons) = 0").drop("reasons")
    return resolution.resolve(signals)[1]
