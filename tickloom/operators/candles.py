"""Candlestick detectors: one projection over one shared window.

A detector is a predicate over the columns that ``components`` makes: o, h, l, c of
the bar and, with a number behind, of the bars before (o1 to c4); body b, range r and
shadows us and ls; the 20-bar means mb, mr and mc of body, range and close (5 bars at
least) and med, the 20-bar median of the body; quantiles; the trend state; and what the
bars after do. A null counts as false. The background looks back 120 bars, and
confirmation takes 5 bars, which is what histories of 120 bars and more have.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import RETURNS, Ask, trend_state, with_quantiles
from ..functions.rolling import ordered, sma

LONG_UPPER = "us / nullif(r, 0) > 0.55 and ls / nullif(r, 0) < 0.10 and b / nullif(r, 0) < 0.30"
LONG_LOWER = "ls / nullif(r, 0) > 0.55 and us / nullif(r, 0) < 0.10 and b / nullif(r, 0) < 0.30"
BOTH_SOLID = "b1 >= 0.55 * med1 and b1 / nullif(r1, 0) >= 0.20 and b >= 0.55 * med and b / nullif(r, 0) >= 0.20"
TOLERANCE = "greatest(0.05 * mr, 0.001 * abs(c))"
INSIDE = (
    f"greatest(o, c) <= greatest(o1, c1) + {TOLERANCE} and least(o, c) >= least(o1, c1) - {TOLERANCE} and b < 0.55 * mb and "
    f"(h <= greatest(o1, c1) + {TOLERANCE} and l >= least(o1, c1) - {TOLERANCE} or h <= h1 + {TOLERANCE} and l >= l1 - {TOLERANCE})"
)
BIG_DOWN_UP, BIG_UP_DOWN = "c1 < o1 and b1 > mb1 and c > o and b > mb", "c1 > o1 and b1 > mb1 and c < o and b > mb"
STAR_UP = "c2 < o2 and b2 > mb2 and c > o and b > mb and c > (o2 + c2) / 2 and r2 > 0"
STAR_DOWN = "c2 > o2 and b2 > mb2 and c < o and b > mb and c < (o2 + c2) / 2 and r2 > 0"
RISING = "c > o and c1 > o1 and c2 > o2 and c > c1 and c1 > c2"
FALLING = "c < o and c1 < o1 and c2 < o2 and c < c1 and c1 < c2"
SOLDIERS = f"{RISING} and b2 > mb2 and b1 > mb1 and b > mb and ls2 / b2 < 0.1 and ls1 / b1 < 0.1 and ls / b < 0.1 and o1 >= (o2 + c2) / 2 and o >= (o1 + c1) / 2"
BLOCK = f"{RISING} and b2 > b1 and b1 > b and us2 < us1 and us1 < us"
PAIRED = "c1 > o1 and c > o and b1 > 0 and abs(b1 - b) / b1 <= 0.30 and after >= 1"

#: Name: direction, bars, predicate.
PREDICATES: dict[str, tuple[str, int, str]] = {
    "doji": ("bear", 1, "b / nullif(r, 0) < 0.08"),
    "long_legged_doji": ("bear", 1, "b / nullif(r, 0) < 0.08 and us > 0.4 * mr and ls > 0.4 * mr"),
    "spinning_top": ("bull", 1, "b / nullif(r, 0) >= 0.08 and b / nullif(r, 0) < 0.25 and us > 0.15 * mr and ls > 0.15 * mr"),
    "long_cross": ("neutral", 1, "b / nullif(r, 0) < 0.08 and us / nullif(r, 0) > 0.25 and ls / nullif(r, 0) > 0.25"),
    "propeller": ("neutral", 1, "b / nullif(r, 0) between 0.08 and 0.25 and b / nullif(r, 0) < 0.25 and us / r > 0.25 and ls / r > 0.25 and abs(us - ls) / r < 0.10"),
    "t_shape": ("neutral", 1, "o = c and c = h and l < c"),
    "inverted_t": ("neutral", 1, "o = c and c = l and h > c"),
    "one_line": ("neutral", 1, "o = c and c = h and h = l"),
    "shooting_star": ("bear", 1, f"{LONG_UPPER} and h > high_mark"),
    "inverted_hammer": ("bull", 1, f"{LONG_UPPER} and l < low_mark"),
    "hammer": ("bull", 1, f"{LONG_LOWER} and l < low_mark and state = 'downtrend' and after = 5 and least_close >= l"),
    "hanging_man": ("neutral", 1, f"{LONG_LOWER} and h > high_mark and state = 'uptrend' and after = 5 and least_low < l"),
    "high_open_escape": ("bear", 1, "b > 1.8 * mb and o > high5 * (1 + mr / mc * 0.5) and us / nullif(r, 0) < 0.08 and (c - l) / nullif(r, 0) < 0.15"),
    "low_open_surge": ("bull", 1, "b > 1.8 * mb and o < low5 * (1 - mr / mc * 0.5) and ls / nullif(r, 0) < 0.08 and (h - c) / nullif(r, 0) < 0.15"),
    "bullish_engulfing": ("bull", 2, f"c1 < o1 and c > o and {BOTH_SOLID} and o <= c1 + abs(c) * 1e-4 and c >= o1 - abs(c) * 1e-4"),
    "bearish_engulfing": ("bear", 2, f"c1 > o1 and c < o and {BOTH_SOLID} and o >= c1 - abs(c) * 1e-4 and c <= o1 + abs(c) * 1e-4"),
    "piercing": ("bull", 2, f"{BIG_DOWN_UP} and (o - c1) / nullif(abs(c1), 0) < -0.005 and c > (o1 + c1) / 2 and c < o1 - abs(o1) * 1e-4 and ls / nullif(r, 0) < 0.30"),
    "dark_cloud": ("bear", 2, f"{BIG_UP_DOWN} and (o - c1) / nullif(abs(c1), 0) > 0.005 and c < (o1 + c1) / 2 and c > o1 + abs(o1) * 1e-4 and us / nullif(r, 0) < 0.30"),
    "bullish_harami": ("bull", 2, f"c1 < o1 and {INSIDE}"),
    "bearish_harami": ("bear", 2, f"c1 > o1 and {INSIDE}"),
    "harami_cross": ("neutral", 2, f"c1 <> o1 and b / nullif(r, 0) < 0.08 and {INSIDE}"),
    "sun": ("bull", 2, f"{BIG_DOWN_UP} and o - c1 < -0.3 * mr and c > o1"),
    "rain": ("bear", 2, f"{BIG_UP_DOWN} and o - c1 > 0.3 * mr and c < o1"),
    "meeting_up": ("bull", 2, f"{BIG_DOWN_UP} and abs(c - c1) <= 0.05 * mr"),
    "meeting_down": ("bear", 2, f"{BIG_UP_DOWN} and abs(c - c1) <= 0.05 * mr"),
    "twin_bulls": ("bull", 2, "c1 > o1 and c > o and abs(b1 - b) / greatest(b1, 1e-9) < 0.25"),
    "twin_bears": ("bear", 2, "c1 < o1 and c < o and abs(b1 - b) / greatest(b1, 1e-9) < 0.25"),
    "tweezer_top": ("bear", 2, "abs(h - h1) <= 0.003 * mr and c1 >= o1 and c < o and c >= close_high"),
    "tweezer_bottom": ("bull", 2, "abs(l - l1) <= 0.003 * mr and c1 <= o1 and c > o and c <= close_low"),
    "exhaustion_top": ("bear", 2, "b1 > mb1 and c1 > o1 and b < 0.5 * mb and l >= greatest(o1, c1) and h <= h1"),
    "exhaustion_bottom": ("bull", 2, "b1 > mb1 and c1 < o1 and b < 0.5 * mb and h <= least(o1, c1) and l >= l1"),
    "kneading": ("neutral", 2, "b1 / nullif(r1, 0) < 0.25 and b / nullif(r, 0) < 0.25 and (us1 / r1 > 0.4 and ls / r > 0.4 or ls1 / r1 > 0.4 and us / r > 0.4)"),
    "gap_twins_high": ("bull", 2, f"l1 > h2 and {PAIRED} and least(l1, l) > h2 and c1 > mc1"),
    "gap_twins_low": ("bull", 2, f"h1 < l2 and {PAIRED} and greatest(h1, h) < l2 and c1 < mc1"),
    "inverted_two": ("bull", 2, "state1 = 'downtrend' and i >= 2 and c1 > o1 and c > o and o < c1 and after >= 1 and not (next_c > next_o and next_o < c)"),
    "morning_star": ("bull", 3, f"{STAR_UP} and b1 / nullif(r1, 0) >= 0.08 and b1 / nullif(r1, 0) < 0.25"),
    "evening_star": ("bear", 3, f"{STAR_DOWN} and b1 / nullif(r1, 0) >= 0.08 and b1 / nullif(r1, 0) < 0.25"),
    "morning_doji_star": ("bull", 3, f"{STAR_UP} and b1 / nullif(r1, 0) < 0.08"),
    "evening_doji_star": ("bear", 3, f"{STAR_DOWN} and b1 / nullif(r1, 0) < 0.08"),
    "morning_doji_cover": ("bull", 3, "c2 < o2 and b2 > mb2 and b1 / greatest(r1, 1e-9) < 0.08 and c > o and b > mb and c > o2"),
    "evening_doji_cover": ("bear", 3, "c2 > o2 and b2 > mb2 and b1 / greatest(r1, 1e-9) < 0.08 and c < o and b > mb and c < o2"),
    "abandoned_baby_up": ("bull", 3, "b1 / nullif(r1, 0) <= 0.08 and b2 / nullif(r2, 0) > 0.08 and b / nullif(r, 0) > 0.08 and c2 < o2 and c > o and state2 = 'downtrend' and h1 < l2 and l > h1"),
    "abandoned_baby_down": ("bear", 3, "b1 / nullif(r1, 0) <= 0.08 and b2 / nullif(r2, 0) > 0.08 and b / nullif(r, 0) > 0.08 and c2 > o2 and c < o and state2 = 'uptrend' and l1 > h2 and h < l1"),
    "three_red": ("neutral", 3, f"{RISING} and us2 / b2 < 0.1 and us1 / b1 < 0.1 and us / b < 0.1 and o1 between o2 and c2 and o between o1 and c1"),
    "white_soldiers": ("bull", 3, SOLDIERS),
    "advance_block": ("neutral", 3, f"{BLOCK} and not ({SOLDIERS})"),
    "deliberation": ("neutral", 3, f"{RISING} and b2 > mb2 and b1 > mb1 and b < 0.5 * mb and greatest(us2, ls2) / r2 > 0.05 and greatest(us1, ls1) / r1 > 0.05 and greatest(us, ls) / r > 0.05 and not ({BLOCK}) and not ({SOLDIERS})"),
    "three_falling": ("bear", 3, FALLING),
    "black_three": ("bear", 3, f"{FALLING} and b2 < mb2 and b1 < mb1 and b < mb and o1 between o2 and c2 and o between o1 and c1"),
    "three_crows": ("bear", 3, f"{FALLING} and b2 >= mb2 and b1 >= mb1 and b >= mb and ls2 / b2 < 0.1 and ls1 / b1 < 0.1 and ls / b < 0.1"),
    "cover_down": ("bear", 3, "c2 < o2 and c1 > o1 and c < o and c < o1 and after >= 1"),
    "cover_up": ("bull", 3, "c2 > o2 and c1 < o1 and c > o and c > o1 and after >= 1"),
    "two_up_one_down": ("bull", 3, "c2 > o2 and c1 > o1 and c < o and c > c2"),
    "two_down_one_up": ("bear", 3, "c2 < o2 and c1 < o1 and c > o and c < c2"),
    "limping": ("bear", 3, "i >= 3 and c2 >= close_high2 and c > o and c1 > o1 and c2 > o2 and c2 > c1 and c1 > c"),
    "inverted_three": ("bull", 3, "i >= 3 and state2 = 'downtrend' and c2 > o2 and c > o and (c1 > o1 and o1 < c2 and o < c1 or c1 < o1 and o < c2)"),
    "two_crows": ("bear", 3, "c2 >= o2 and c2 >= close_high2 and c1 < o1 and o1 > c2 and c1 >= o2 and c < o and o > o1 and c < c1"),
    "three_gap_rise": ("bull", 3, "c > o and c1 > o1 and c2 > o2 and o1 > c2 and o > c1"),
    "three_gap_decline": ("bear", 3, "c < o and c1 < o1 and c2 < o2 and o1 < c2 and o < c1"),
    "three_tweezers": (
        "neutral", 3,
        "b2 > mb2 and b > mb and b1 < 0.5 * mb1 and (c2 > o2 and c < o and abs(h2 - h1) <= 0.003 * mr and abs(h1 - h) <= 0.003 * mr or c2 < o2 and c > o and abs(l2 - l1) <= 0.003 * mr and abs(l1 - l) <= 0.003 * mr)",
    ),
    "rising_three_methods": ("bull", 5, "c4 > o4 and b4 > mb4 and c > o and b > mb and int(c3 < o3) + int(c2 < o2) + int(c1 < o1) >= 2 and least(l3, l2, l1) >= o4 and c > greatest(h3, h2, h1)"),
    "falling_three_methods": ("bear", 5, "c4 < o4 and b4 > mb4 and c < o and b > mb and int(c3 > o3) + int(c2 > o2) + int(c1 > o1) >= 2 and greatest(h3, h2, h1) <= o4 and c < least(l3, l2, l1)"),
    "falling_three_stars": ("bear", 5, "c4 < o4 and b4 > 1.5 * mb4 and b3 < 0.8 * mb3 and b2 < 0.8 * mb2 and b1 < 0.8 * mb1 and greatest(h3, h2, h1) < l4 and c < o and b > 1.5 * mb and c < least(l3, l2, l1)"),
}
GROUPS = {name: tuple(p for p, (_, bars, _) in PREDICATES.items() if bars == n) for name, n in (("single", 1), ("two_bar", 2), ("three_bar", 3), ("five_bar", 5))}
#: Of a bar's patterns the strongest stays: fixed order.
PRIORITY = (
    "bullish_engulfing bearish_engulfing piercing dark_cloud sun rain shooting_star hanging_man hammer inverted_hammer long_legged_doji doji spinning_top t_shape inverted_t one_line"
).split()


#: The quantiles that detectors ask for.
ASKS = RETURNS | {
    "middle": Ask("b", 0.5, 20, 3), "high_mark": Ask("h", 0.8, 10, 3), "low_mark": Ask("l", 0.2, 10, 3), "close_high": Ask("c", 0.8, 20, 5), "close_low": Ask("c", 0.2, 20, 5),
}


def components(bars: DataFrame) -> DataFrame:
    w = ordered()
    rows = bars.select("symbol", "ts", F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))
    rows = rows.withColumns({"b": F.abs(F.col("c") - F.col("o")), "ret": F.try_divide("c", F.lag("c", 20).over(w)) - 1})
    rows = with_quantiles(rows, ASKS)
    rows = rows.withColumns({"r": F.col("h") - F.col("l"), "us": F.col("h") - F.greatest("o", "c"), "ls": F.least("o", "c") - F.col("l"), "i": F.row_number().over(w)})
    five, before5 = w.rowsBetween(1, 5), w.rowsBetween(-5, -1)
    past5 = F.count(F.lit(1)).over(before5) >= 3
    rows = rows.withColumns({
        "mb": sma(F.col("b"), 20, 5), "mr": sma(F.col("r"), 20, 5), "mc": sma(F.col("c"), 20, 5),
        "med": F.coalesce(F.nullif("middle", F.lit(0.0)), F.percentile("b", 0.5).over(Window.partitionBy("symbol"))),
        "high5": F.when(past5, F.max("h").over(before5)), "low5": F.when(past5, F.min("l").over(before5)),
        "after": F.count("c").over(five), "least_close": F.min("c").over(five), "least_low": F.min("l").over(five),
        "next_o": F.lead("o").over(w), "next_c": F.lead("c").over(w),
    })
    rows = rows.withColumn("state", trend_state(F.col("ret")))
    lags = {f"{x}{k}": F.lag(x, k).over(w) for x in ("o", "h", "l", "c", "b", "r", "us", "ls", "mb") for k in range(1, 5)}
    lags |= {f"{x}{k}": F.lag(x, k).over(w) for x in ("mc", "state", "close_high") for k in (1, 2)}
    return rows.withColumns(lags | {"med1": F.coalesce(F.lag("med").over(w), F.col("med"))})


def guarded(predicate: str) -> str:
    """Divisions by a column give null where it is 0."""
    return re.sub(r"/ (\w+)\b(?!\()", r"/ nullif(\1, 0)", predicate)


def detect(bars: DataFrame, group: str | None = None, recent: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, ts, pattern, direction, bars): one row per bar and pattern that it completes; if asked only for each symbol's last bars, and with more of ``components``."""
    hits = []
    for name in GROUPS[group] if group else PREDICATES:
        direction, n, predicate = PREDICATES[name]
        event = F.struct(F.lit(name).alias("pattern"), F.lit(direction).alias("direction"), F.lit(n).alias("bars"))
        hits.append(F.when(F.coalesce(F.expr(guarded(predicate)), F.lit(False)), event))
    rows = components(bars)
    if recent is not None:
        rows = rows.withColumn("last_i", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(F.col("i") > F.col("last_i") - recent)
    return rows.select("symbol", "ts", *keep, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("symbol", "ts", *keep, "hit.*")


def strongest(patterns: DataFrame) -> DataFrame:
    """Of each (symbol, ts) the pattern that comes first in ``PRIORITY``; all of them where none is listed."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("pattern"))
    listed = patterns.withColumn("rank", F.when(rank > 0, rank))
    by_bar = Window.partitionBy("symbol", "ts")
    return listed.withColumn("best", F.min("rank").over(by_bar)).where("rank = best or best is null").drop("rank", "best")
