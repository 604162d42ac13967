"""Yearly values, percentiles by position, growth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def yearly_last_positive(rows: DataFrame) -> DataFrame:
    """(key, year, value): the last positive value of each year from (key, ts, order, value)."""
    return rows.where("value > 0").groupBy("key", F.year("ts").alias("year")).agg(F.max_by("value", F.struct("ts", "tie")).alias("value"))


def percentile_zone(rows: DataFrame) -> DataFrame:
    """Current value's percentile among positive values, and the values at 20 and 80 percent by position."""
    positive = rows.where("value > 0")
    grouped = positive.groupBy("key").agg(F.max_by("value", F.struct("ts", "tie")).alias("current"), F.sort_array(F.collect_list("value")).alias("sorted"))
    n = F.size("sorted")
    pick = lambda q: F.get("sorted", F.least(n - 1, F.floor(n * q).cast("int")))
    share = F.size(F.filter("sorted", lambda v: v <= F.col("current"))) / n * 100
    out = grouped.select("key", "current", share.alias("percentile"), pick(0.2).alias("p20"), pick(0.8).alias("p80"))
    return out.withColumn("zone", F.when(F.col("current") <= F.col("p20"), "low").when(F.col("current") >= F.col("p80"), "high").otherwise("middle"))


def growth(yearly: DataFrame) -> DataFrame:
    """Compound yearly growth in percent between the first and last year."""
    ends = yearly.groupBy("key").agg(F.min_by("value", "year").alias("a"), F.max_by("value", "year").alias("b"), (F.max("year") - F.min("year")).alias("years")).where("years > 0")
    return ends.select("key", "years", ((F.pow(F.try_divide("b", "a"), 1 / F.col("years")) - 1) * 100).alias("cagr"))
