"""Indicators that are recurrences, and what is measured on their signals.

Linear recurrences run in blocks of time (``recurrence``). SuperTrend isn't linear, so
each symbol's bars are one group of a grouped pandas function for it; all else is
window functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import recurrence
from ..functions.rolling import ordered, simple_return


def ema(x: pd.Series, span: float) -> pd.Series:
    return x.ewm(span=span, adjust=False).mean()


def wilder(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(alpha=1 / n, adjust=False).mean()


def per_symbol(bars: DataFrame, compute, added: str) -> DataFrame:
    """``compute(bars in time order)`` adds the columns ``added`` for each symbol."""
    columns = bars.select("symbol", "ts", "high", "low", "close")
    kind = columns.schema["ts"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts", ignore_index=True)
        return pd.concat([group[["symbol", "ts", "close"]], compute(group)], axis=1)

    return columns.groupBy("symbol").applyInPandas(run, f"symbol string, ts {kind}, close double, {added}")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, block: str = "year") -> DataFrame:
    return recurrence.run(bars, recurrence.macd(fast, slow, signal), block)


def ewm(bars: DataFrame, span: int = 12, block: str = "year") -> DataFrame:
    return recurrence.run(bars, recurrence.ewm(span), block)


def rsi_values(close: pd.Series, n: int) -> pd.Series:
    """50 where there is no average loss, as for the first bar."""
    change = close.diff()
    gain, loss = wilder(change.clip(lower=0), n), wilder(-change.clip(upper=0), n)
    return (100 - 100 / (1 + gain / loss.where(loss != 0))).fillna(50.0)


def rsi(bars: DataFrame, n: int = 14, block: str = "year") -> DataFrame:
    return recurrence.run(bars, recurrence.rsi(n), block)


def kdj(bars: DataFrame, n: int = 9, k: int = 3, d: int = 3, block: str = "year") -> DataFrame:
    return recurrence.run(bars, recurrence.kdj(n, k, d), block)


def atr_values(g: pd.DataFrame, n: int) -> pd.Series:
    before = g["close"].shift()
    ranges = pd.concat([g["high"] - g["low"], (g["high"] - before).abs(), (g["low"] - before).abs()], axis=1)
    return wilder(ranges.max(axis=1), n)


def supertrend_values(g: pd.DataFrame, n: int, multiple: float) -> tuple[np.ndarray, np.ndarray]:
    """Line and trend (1 up, 0 down); the first bar has no line. A band only moves towards the price until the close before it had left it."""
    middle, width = (g["high"] + g["low"]) / 2, multiple * atr_values(g, n)
    upper, lower = (middle + width).to_numpy(copy=True), (middle - width).to_numpy(copy=True)
    close, trend = g["close"].to_numpy(), np.ones(len(g), dtype=np.int64)
    for i in range(1, len(g)):
        if upper[i] > upper[i - 1] and close[i - 1] <= upper[i - 1]:
            upper[i] = upper[i - 1]
        if lower[i] < lower[i - 1] and close[i - 1] >= lower[i - 1]:
            lower[i] = lower[i - 1]
        trend[i] = 1 if close[i] > upper[i - 1] else 0 if close[i] < lower[i - 1] else trend[i - 1]
    line = np.where(trend == 1, lower, upper)
    line[:1] = np.nan
    return line, trend


def supertrend(bars: DataFrame, n: int = 10, multiple: float = 3.0) -> DataFrame:
    def compute(g: pd.DataFrame) -> pd.DataFrame:
        line, trend = supertrend_values(g, n, multiple)
        return pd.DataFrame({"line": line, "trend": trend})

    return per_symbol(bars, compute, "line double, trend long")


def transitions(signals: DataFrame, last: int = 8, within: int = 80) -> DataFrame:
    """The last changes of a 0/1 signal among the last ``within`` bars of each symbol."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    changed = signals.withColumns({"before": F.lag("signal").over(ordered()), "back": back}).where((F.col("back") <= within) & F.col("before").isNotNull() & (F.col("before") != F.col("signal")))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    return changed.withColumn("rank", rank).where(F.col("rank") <= last).select("symbol", "ts", "rank", "signal")


def backtest(signals: DataFrame) -> DataFrame:
    """Profit factor, return, drawdown, trades and win rate of holding while the signal before was 1."""
    held = F.coalesce(F.lag("signal").over(ordered()), F.lit(0))
    rows = signals.select("symbol", "ts", "close", "signal", (F.coalesce(simple_return(), F.lit(0.0)) * held).alias("strategy"), F.row_number().over(ordered()).alias("i"), F.lag("signal", 1, 0).over(ordered()).alias("before"))
    so_far = ordered().rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("symbol").orderBy(F.col("ts").desc())  # running frames from the end, as frames that end at the last row are built anew for each row
    onward = backward.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("equity", F.product(1 + F.greatest("strategy", F.lit(-0.99))).over(so_far))
    rows = rows.withColumns({
        "drawdown": F.try_divide("equity", F.greatest(F.max("equity").over(so_far), F.lit(1e-12))) - 1,
        "exit": F.coalesce(F.min(F.when((F.col("signal") == 0) & (F.col("before") == 1), F.struct("i", "close"))).over(onward)["close"], F.first("close").over(backward.rowsBetween(Window.unboundedPreceding, 0))),
    })
    entry = (F.col("signal") == 1) & (F.col("before") == 0)
    gain, loss = F.sum(F.when(F.col("strategy") > 0, F.col("strategy")).otherwise(0.0)), F.sum(F.when(F.col("strategy") < 0, -F.col("strategy")).otherwise(0.0))
    won = F.sum(F.when(entry & (F.col("exit") > F.col("close")), 1).otherwise(0))
    out = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (gain / F.greatest(loss, F.lit(1e-9))).alias("profit_factor"), ((F.max_by("equity", "ts") - 1) * 100).alias("return_pct"), (F.min("drawdown") * 100).alias("drawdown_pct"), F.sum(F.when(entry, 1).otherwise(0)).alias("trades"), won.alias("won"))
    win = F.coalesce(F.try_divide("won", "trades"), F.lit(0.0))
    score = (F.least("profit_factor", F.lit(8.0)) * 0.5 + win * 2 + F.greatest("return_pct", F.lit(-80.0)) / 100 + F.col("drawdown_pct") / 180) * F.least(F.lit(1.0), F.col("trades") / 5)
    return out.where("n >= 30").select("symbol", "profit_factor", "return_pct", "drawdown_pct", "trades", win.alias("win_rate"), score.alias("score"))


def discreteness(bars: DataFrame, n: int = 60) -> DataFrame:
    """Information discreteness of the last n returns: sign of the return times (share down - share up)."""
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    rows = bars.select("symbol", "ts", simple_return().alias("ret")).where("ret is not null").withColumn("rn", last).where(F.col("rn") <= n)
    grouped = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (F.product(1 + F.col("ret")) - 1).alias("total"), F.avg((F.col("ret") < 0).cast("int")).alias("down"), F.avg((F.col("ret") > 0).cast("int")).alias("up"), F.sort_array(F.collect_list(F.abs("ret")), asc=False).alias("sizes"))
    top = F.aggregate(F.slice("sizes", 1, 5), F.lit(0.0), lambda a, x: a + x)
    whole = F.aggregate("sizes", F.lit(0.0), lambda a, x: a + x)
    return grouped.where("n >= 20").select("symbol", (F.when(F.col("total") >= 0, 1.0).otherwise(-1.0) * (F.col("down") - F.col("up"))).alias("discreteness"), (top / F.greatest(whole, F.lit(1e-12))).alias("top5_share"))


def discreteness_class(value: Column, top5_share: Column) -> Column:
    """Moves on few days, piled up over many, or to and fro."""
    return F.when(top5_share >= 0.55, "concentrated").when(F.abs(value) >= 0.28, "cumulative").otherwise("mixed")


def discreteness_history(bars: DataFrame, n: int = 60) -> DataFrame:
    """``discreteness`` of the n returns up to each bar from bar n on, with the share of the five largest moves."""
    w = ordered().rowsBetween(-(n - 1), 0)
    rows = bars.select("symbol", "ts", simple_return().alias("ret"), F.row_number().over(ordered()).alias("i"))
    wide = rows.select("symbol", "ts", "i", F.product(1 + F.col("ret")).over(w).alias("grown"), F.avg((F.col("ret") < 0).cast("int")).over(w).alias("down"), F.avg((F.col("ret") > 0).cast("int")).over(w).alias("up"), F.sum(F.abs("ret")).over(w).alias("moved"), F.sort_array(F.collect_list(F.abs("ret")).over(w), asc=False).alias("sizes"))
    top = F.aggregate(F.slice("sizes", 1, 5), F.lit(0.0), lambda a, x: a + x)
    side = F.when(F.col("grown") >= 1, 1.0).otherwise(-1.0)
    return wide.where((F.col("i") > n) & (F.size("sizes") >= 20)).select("symbol", "ts", (side * (F.col("down") - F.col("up"))).alias("discreteness"), (top / F.greatest("moved", F.lit(1e-12)) * 100).alias("top5_pct"))
