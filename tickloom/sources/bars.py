"""Price bars from landed files and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume")


def from_delimited_lines(lines: DataFrame, symbol: str = "symbol", line: str = "line") -> DataFrame:
    """Lines ``date,open,close,high,low,volume``; short lines are padded with nulls."""
    cells = F.split(F.col(line), ",")
    cell = lambda i: F.expr(f"try_cast(get(split({line}, ','), {i}) as double)")
    return lines.select(F.col(symbol).alias("symbol"), F.to_date(F.get(cells, 0)).alias("ts"), cell(1).alias("open"), cell(3).alias("high"), cell(4).alias("low"), cell(2).alias("close"), F.coalesce(cell(5), F.lit(0.0)).alias("volume"))


def from_objects(rows: DataFrame, symbol: str = "symbol", text: str = "json") -> DataFrame:
    """A JSON array of ``{d,o,h,l,c,v}``, also inside a call like ``name=([...]);``; a null volume is 0."""
    body = F.regexp_extract(F.col(text), r"(\[.*\])", 1)
    parsed = F.from_json(body, "array<struct<d:string,o:string,h:string,l:string,c:string,v:string>>")
    number = lambda c: F.expr(f"try_cast(bar.{c} as double)")
    return rows.select(F.col(symbol).alias("symbol"), F.explode(parsed).alias("bar")).select("symbol", F.to_date("bar.d").alias("ts"), number("o").alias("open"), number("h").alias("high"), number("l").alias("low"), number("c").alias("close"), F.coalesce(number("v"), F.lit(0.0)).alias("volume"))


def from_parallel_arrays(rows: DataFrame) -> DataFrame:
    """Columns symbol, timestamp (seconds), open, high, low, close, volume, all but the first arrays."""
    zipped = F.arrays_zip("timestamp", "open", "high", "low", "close", "volume")
    return rows.select("symbol", F.inline(zipped)).select("symbol", F.to_date(F.timestamp_seconds("timestamp")).alias("ts"), "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def by_precedence(sources: list[DataFrame]) -> DataFrame:
    """For each symbol, all bars of the first source that has any."""
    union = None
    for rank, bars in enumerate(sources):
        one = bars.select(*BAR_COLUMNS).withColumn("rank", F.lit(rank))
        union = one if union is None else union.unionByName(one)
    first = union.groupBy("symbol").agg(F.min("rank").alias("rank"))
    return union.join(first, ["symbol", "rank"]).drop("rank")


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (day), price, size and a total order of the ticks of a bar."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("ts"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("size"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("tick")
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.struct("ts", "event_id").alias("tick"))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("size"), F.struct("o_orderkey").alias("tick"))


def series_csv(spark: SparkSession, path: str) -> DataFrame:
    """observation_date,<ID> files as (series_id, date, value); ``.``, ``NA`` and blanks are missing."""
    rows = spark.read.csv(path, header=True)
    name = next(c for c in rows.columns if c != "observation_date")
    value: Column = F.expr(f"try_cast(`{name}` as double)")
    return rows.select(F.lit(name).alias("series_id"), F.to_date("observation_date").alias("date"), value.alias("value")).where("value is not null")


def supplier_walk(spark: SparkSession, sf_dir: str, scale: float = 0.3) -> DataFrame:
    """Weekly ticks of one walk a supplier: each line item moves the price by its discount's distance from 5 %."""
    by = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    price = F.lit(100.0) * F.exp(F.lit(scale) * F.sum(F.col("l_discount") - 0.05).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # a tick is its number in the walk: bars of numbers are hashed, those of structs sorted
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_quantity", "l_shipdate", price.alias("price"), F.row_number().over(by).alias("tick"))
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    return rows.select(F.col("l_suppkey").cast("string").alias("symbol"), week.alias("ts"), "price", F.col("l_quantity").alias("size"), "tick")
