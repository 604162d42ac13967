"""Bars: build, clean, resample, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ordered, sma

PERIODS = {"week": lambda ts: F.next_day(F.date_sub(ts, 1), "FRI"), "month": lambda ts: F.last_day(ts)}


def build(ticks: DataFrame) -> DataFrame:
    """OHLCV bars from (symbol, ts, price, size, tick); partial aggregates run before the shuffle."""
    return ticks.where("price > 0").groupBy("symbol", "ts").agg(F.min_by("price", "tick").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "tick").alias("close"), F.sum("size").alias("volume"))


def clean(rows: DataFrame, arrival: str) -> DataFrame:
    """Consistent bars only; of bars with one (symbol, ts), the last to arrive."""
    number = {c: F.expr(f"try_cast({c} as double)") for c in ("open", "high", "low", "close", "volume")}
    cast = rows.withColumns({c: F.when(~F.isnan(x), x) for c, x in number.items()})
    valid = cast.where("close > 0 and high >= greatest(open, close) and low <= least(open, close)")
    last = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(F.col(arrival).desc()))
    return valid.withColumn("rn", last).where("rn = 1").drop("rn")


def resample(bars: DataFrame, period: str) -> DataFrame:
    """Bars by Friday-ended week or by month, labelled with the last day of the period."""
    label: Column = PERIODS[period](F.col("ts"))
    return bars.groupBy("symbol", label.alias("period")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("period", "ts")


def as_of(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """``left`` with the last non-null ``value`` of ``right`` at or before its time, by symbol.

    Both sides become one stream of rows per symbol; a running last value passes
    from one to the other, so there is one exchange and no range join.
    """
    side = F.lit(None).cast("double")
    both = left.select("symbol", "ts", F.struct(*[c for c in left.columns]).alias("row"), side.alias("held"), F.lit(1).alias("is_left")).unionByName(right.select("symbol", "ts", F.lit(None).alias("row"), F.col(value).alias("held"), F.lit(0).alias("is_left")))
    run = Window.partitionBy("symbol").orderBy("ts", "is_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("held", F.last("held", ignorenulls=True).over(run)).where("is_left = 1").select("row.*", F.col("held").alias(value))


def with_index(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_idx", F.row_number().over(ordered()) - 1)


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol; a rank limit runs before the shuffle."""
    last = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return bars.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= n).drop("rn")


def long_average(bars: DataFrame, n: int = 250) -> DataFrame:
    return bars.withColumn("long_ma", sma(F.col("close"), n))
