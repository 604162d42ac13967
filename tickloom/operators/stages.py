"""Stages, bodies, confirmation, divergence, returns side by side and interpolated averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ordered, simple_return, sma
from .bars import resample, with_index


def three_stages(bars: DataFrame, move: float = 0.03) -> DataFrame:
    """Each symbol's bars in three parts of equal length (earlier ones longer by one): change and state."""
    parts = bars.withColumn("stage", F.ntile(3).over(ordered())).groupBy("symbol", "stage")
    out = parts.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (F.try_divide(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1).alias("change"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return out.withColumn("state", F.when(F.col("change") > move, "up").when(F.col("change") < -move, "down").otherwise("flat"))


def body_class(bars: DataFrame) -> DataFrame:
    """Size class of each body against its 20-bar mean; edges belong to the class below."""
    rows = bars.select("symbol", "ts", F.abs(F.col("close") - F.col("open")).alias("b"))
    rows = rows.select("symbol", "ts", F.try_divide(F.col("b"), sma(F.col("b"), 20, 5)).alias("ratio"))
    named = F.when(F.col("ratio") <= 0.08, "doji").when(F.col("ratio") <= 0.8, "small").when(F.col("ratio") <= 2.0, "medium").otherwise("large")
    return rows.where("ratio is not null").select("symbol", "ts", named.alias("class"))


def big_candles(bars: DataFrame, multiple: float = 2.0, shadow: float = 0.15, body: float = 0.85) -> DataFrame:
    """Full-bodied candles, the largest of each symbol up to a quota that falls with its number of bars."""
    rows = bars.select("symbol", "ts", "open", "close", (F.col("high") - F.col("low")).alias("r"), F.abs(F.col("close") - F.col("open")).alias("b"))
    rows = rows.withColumns({"mean": sma(F.col("b"), 20, 2), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    part = F.try_divide("b", "r")
    found = rows.where((F.col("b") > F.col("mean") * multiple) & (1 - part < shadow) & (part > body))
    n = F.col("n")
    ratio = F.when(n <= 50, 0.10).when(n <= 120, 0.10 - (n - 50) * (0.02 / 70)).otherwise(F.greatest(F.lit(0.06), 0.08 - (n - 120) * (0.02 / 80)))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("b").desc(), "ts"))
    return found.withColumn("rank", rank).where(F.col("rank") <= F.greatest(F.lit(1), F.bround(n * ratio))).select("symbol", "ts", F.when(F.col("close") > F.col("open"), "bullish").otherwise("bearish").alias("kind"), "rank")


def held_lows(bars: DataFrame, k: int = 5) -> DataFrame:
    """Whether the next k closes stay at or above the bar's low; null where there are fewer."""
    ahead = ordered().rowsBetween(1, k)
    return bars.select("symbol", "ts", F.when(F.count("close").over(ahead) == k, F.min("close").over(ahead) >= F.col("low")).alias("held"))


def volume_divergence(bars: DataFrame, n: int = 60, least: int = 30) -> DataFrame:
    """Correlation of the changes of price and volume within the last n bars of each symbol."""
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    changes = bars.select("symbol", "ts", simple_return().alias("p"), simple_return("volume").alias("v")).withColumn("k", last).where(F.col("k") < n).where("p is not null and v is not null")
    return changes.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.corr("p", "v").alias("divergence")).where(F.col("n") >= least).drop("n")


def return_matrix(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Returns side by side on the dates that all ``symbols`` share: one shuffle instead of a chain of joins."""
    rows = bars.select("symbol", "ts", simple_return().alias("ret")).where("ret is not null")
    wide = rows.groupBy("ts").agg(*[F.max(F.when(F.col("symbol") == s, F.col("ret"))).alias(f"ret_{s.lower()}") for s in symbols])
    return wide.dropna()


def weekly_average_by_day(bars: DataFrame, n: int = 12) -> DataFrame:
    """The n-week mean on every day: at a week's last bar its value, linear between, level at the ends."""
    weekly = resample(bars, "week").select("symbol", F.col("ts").alias("week"), sma(F.col("close"), n).alias("mean"))
    week = F.next_day(F.date_sub("ts", 1), "FRI")
    days = with_index(bars.select("symbol", "ts")).withColumn("week", week)
    days = days.withColumn("is_last", F.col("ts") == F.max("ts").over(Window.partitionBy("symbol", "week"))).join(weekly, ["symbol", "week"])
    known = F.when(F.col("is_last") & F.col("mean").isNotNull(), F.struct(F.col("bar_idx").alias("at"), F.col("mean").alias("value")))
    rows = days.select("symbol", "ts", "bar_idx", known.alias("known"))
    a = F.last("known", ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    backward = Window.partitionBy("symbol").orderBy(F.col("ts").desc())  # a running frame, as one that ends at the last row is built anew for each row
    b = F.last("known", ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("symbol", "ts", "bar_idx", a.alias("a"), b.alias("b"))
    between = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * F.coalesce(F.try_divide(F.col("bar_idx") - F.col("a.at"), F.col("b.at") - F.col("a.at")), F.lit(0.0))
    return rows.select("symbol", "ts", F.coalesce(between, F.col("a.value"), F.col("b.value")).alias("center"))
