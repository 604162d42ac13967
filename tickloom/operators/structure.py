"""Series structure: runs, drawdown, gaps, islands, pivots, levels, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ordered, run_id, simple_return
from .bars import with_index


def wealth(bars: DataFrame) -> DataFrame:
    """Growth of one unit, its running top and the drawdown from it."""
    so_far = ordered().rowsBetween(Window.unboundedPreceding, 0)
    grown = bars.select("symbol", "ts", (1 + F.coalesce(simple_return(), F.lit(0.0))).alias("factor")).withColumn("wealth", F.product("factor").over(so_far))
    return grown.withColumn("drawdown", F.try_divide(F.col("wealth"), F.max("wealth").over(so_far)) - 1)


def runs(bars: DataFrame) -> DataFrame:
    """Runs of rising, falling or flat closes: symbol, run, sign, first and last time, length."""
    sign = F.signum(F.col("close") - F.lag("close").over(ordered()))
    signed = bars.select("symbol", "ts", sign.alias("sign")).where("sign is not null")
    numbered = signed.withColumn("run", run_id(~F.col("sign").eqNullSafe(F.lag("sign").over(ordered()))))
    return numbered.groupBy("symbol", "run", "sign").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("length"))


def gaps(bars: DataFrame, horizon: int | None = None, block: int = 64) -> DataFrame:
    """Price gaps with the first later bar that fills them, at most ``horizon`` bars on if given.

    Bars fall into blocks with their lowest low and highest high. A gap looks at the
    blocks of its symbol for the first one after its own that holds a fill, then at
    the bars of its own block and of that one, so it never meets all later bars.
    """
    rows = with_index(bars)
    before = lambda c: F.lag(c).over(ordered())
    number = F.floor(F.col("bar_idx") / block).cast("int")
    found = rows.select("symbol", "ts", "bar_idx", "low", "high", before("high").alias("prev_high"), before("low").alias("prev_low")).where("low > prev_high or high < prev_low")
    up = F.col("low") > F.col("prev_high")
    edges = found.select("symbol", "ts", "bar_idx", F.when(up, "up").otherwise("down").alias("direction"), F.when(up, F.col("prev_high")).otherwise(F.col("high")).alias("bottom"), F.when(up, F.col("low")).otherwise(F.col("prev_low")).alias("top"), number.alias("own"))
    extremes = rows.groupBy("symbol", number.alias("block")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    listed = extremes.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("block", "low", "high"))).alias("blocks"))  # one entry for ``block`` bars
    fills = lambda low, high: F.when(F.col("direction") == "up", low <= F.col("bottom")).otherwise(high >= F.col("top"))
    later = F.filter("blocks", lambda b: (b["block"] > F.col("own")) & fills(b["low"], b["high"]))
    looks = edges.join(listed, "symbol").select("symbol", "bar_idx", "direction", "bottom", "top", F.explode(F.array_compact(F.array(F.col("own"), F.get(later, F.lit(0))["block"]))).alias("block"))
    inside = rows.select("symbol", number.alias("block"), F.col("bar_idx").alias("at"), F.col("low").alias("later_low"), F.col("high").alias("later_high"))
    hits = looks.join(inside, ["symbol", "block"]).where((F.col("at") > F.col("bar_idx")) & fills(F.col("later_low"), F.col("later_high")))
    first = hits.groupBy("symbol", "bar_idx").agg(F.min("at").alias("filled_idx"))
    near = F.lit(True) if horizon is None else F.col("filled_idx") - F.col("bar_idx") <= horizon
    return edges.drop("own").join(first, ["symbol", "bar_idx"], "left").withColumn("filled_idx", F.when(near, F.col("filled_idx")))


def window_support(bars: DataFrame, forward: int = 5) -> DataFrame:
    """``gaps`` with ``held``: whether the ``forward`` bars after the fill stay on the fill bar's side; null without a fill or so many bars."""
    w = ordered()
    ahead = w.rowsBetween(1, forward)
    full = F.count(F.lit(1)).over(ahead) == forward
    after = with_index(bars).select("symbol", F.col("bar_idx").alias("filled_idx"), F.when(full, F.min("low").over(ahead) >= F.col("low")).alias("floor"), F.when(full, F.max("high").over(ahead) <= F.col("high")).alias("ceiling"))
    return gaps(bars).join(after, ["symbol", "filled_idx"], "left").withColumn("held", F.when(F.col("direction") == "up", F.col("floor")).otherwise(F.col("ceiling"))).drop("floor", "ceiling")


def islands(bars: DataFrame, most: int = 9) -> DataFrame:
    """Opposite gaps at most ``most`` bars apart: the next gap of the symbol is enough to look at."""
    found = gaps(bars).select("symbol", "ts", "bar_idx", "direction")
    after = lambda c: F.lead(c).over(Window.partitionBy("symbol").orderBy("bar_idx"))
    paired = found.withColumns({"end_idx": after("bar_idx"), "end_direction": after("direction")})
    return paired.where((F.col("end_direction") != F.col("direction")) & (F.col("end_idx") - F.col("bar_idx") <= most)).select("symbol", F.col("bar_idx").alias("start_idx"), "end_idx", F.when(F.col("direction") == "up", "top").otherwise("bottom").alias("kind"))


def pivots(bars: DataFrame, radius: int = 5) -> DataFrame:
    """Bars whose high (low) is the extreme of ``radius`` bars to both sides, all present."""
    around = ordered().rowsBetween(-radius, radius)
    full = F.count(F.lit(1)).over(around) == 2 * radius + 1
    rows = with_index(bars).withColumns({"is_high": full & (F.col("high") == F.max("high").over(around)), "is_low": full & (F.col("low") == F.min("low").over(around))})
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("is_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(F.col("is_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"))))))
    return rows.select("symbol", "ts", "bar_idx", kinds.alias("p")).select("symbol", "ts", "bar_idx", "p.kind", "p.price")


def levels(bars: DataFrame, radius: int = 5, per_side: int = 3) -> DataFrame:
    """The nearest pivots above and below the last close of each symbol."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close"))
    sided = pivots(bars, radius).join(last, "symbol").where("price <> last_close").withColumn("side", F.when(F.col("price") > F.col("last_close"), "resistance").otherwise("support"))
    near = Window.partitionBy("symbol", "side").orderBy(F.abs(F.col("price") - F.col("last_close")), "bar_idx")
    return sided.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= per_side).select("symbol", "side", "rank", "bar_idx", "price")


def merge_ranges(ranges: DataFrame, key: str, gap: int = 1) -> DataFrame:
    """Union of (start_idx, end_idx) ranges that overlap or lie at most ``gap`` apart.

    Rows without a start come last and join the last union. A range that ends before it
    starts meets not even its own copy, so unions are counted by rows, not by equal ranges.
    """
    by = Window.partitionBy(key).orderBy(F.asc_nulls_last("start_idx"), F.asc_nulls_last("end_idx"))
    top = F.max("end_idx").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(top.isNull() | (F.col("start_idx") > top + gap), 1).otherwise(0)
    return ranges.withColumn("new", new).withColumn("grp", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "grp").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.count(F.lit(1)).alias("n")).drop("grp")
