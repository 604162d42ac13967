"""What the bars say about a signal's own span, and about a symbol's history as a whole.

``span_evidence`` asks the bars at four places a span and no more, however long it
is: counts are differences of running sums, runs end at the span's last bar, the
highest and lowest bar come from a sparse table (the extremes of 1, 2, 4, ... bars
from each bar on, two of which cover any span), and what follows the confirmation
comes from extremes up to the last bar. So a span costs the same with 5 bars as with
5,000, and long spans over one history don't meet its bars one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.rolling import ordered
from .bars import with_index

FAR = 0.03
TINY = 1e-12
#: What a span asks of a bar.
KEPT = ("bulls", "bears", "bull_run", "bear_run", "is_bull", "is_bear", "to_last", "high_after", "low_after", "all_fall", "all_rise", "held_above", "held_below", "high", "low")


def run_up_to(holds: Column) -> Column:
    """How many bars up to each one hold, without a break."""
    broke = F.last(F.when(~holds, F.col("bar_idx")), ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return (F.col("bar_idx") - F.coalesce(broke, F.lit(-1))).cast("long")


def lookups(bars: DataFrame, most: int) -> DataFrame:
    """One row a bar with what spans of up to ``most`` bars ask of it."""
    so_far = ordered().rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("symbol").orderBy(F.col("ts").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = with_index(bars)
    bull, bear = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    rows = rows.withColumns({
        "bulls": F.sum(bull.cast("long")).over(so_far), "bears": F.sum(bear.cast("long")).over(so_far), "bull_run": run_up_to(bull), "bear_run": run_up_to(bear),
        "is_bull": bull.cast("long"), "is_bear": bear.cast("long"),
        "worst3": F.when(F.col("bar_idx") >= 2, F.min("close").over(ordered().rowsBetween(-2, 0))), "best3": F.when(F.col("bar_idx") >= 2, F.max("close").over(ordered().rowsBetween(-2, 0))),
        "falls": F.col("close") < F.lag("close").over(ordered()), "rises": F.col("close") > F.lag("close").over(ordered()),
    })
    # up to the last bar: the highest and lowest close, and whether all steps after this bar fall or rise
    rows = rows.withColumns({
        "to_last": F.count(F.lit(1)).over(back), "high_after": F.max("close").over(back), "low_after": F.min("close").over(back),
    })
    rows = rows.withColumns({"next_falls": F.lead("falls").over(ordered()), "next_rises": F.lead("rises").over(ordered()), "floor3": F.lead("worst3", 2).over(ordered()), "ceiling3": F.lead("best3", 2).over(ordered())})
    rows = rows.withColumns({
        "all_fall": F.coalesce(F.min("next_falls").over(back), F.lit(True)), "all_rise": F.coalesce(F.min("next_rises").over(back), F.lit(True)),
        "held_above": F.max("floor3").over(back), "held_below": F.min("ceiling3").over(back),
    })
    highs, lows, width = ["high"], ["low"], 1
    while width * 2 <= most:
        level = len(highs)
        for names, best, name in ((highs, F.greatest, "high"), (lows, F.least, "low")):
            rows = rows.withColumn(f"{name}_{level}", best(F.col(names[-1]), F.lead(names[-1], width).over(ordered())))
            names.append(f"{name}_{level}")
        width *= 2
    return rows.withColumns({"highs": F.array(*highs), "lows": F.array(*lows)})


def span_evidence(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """``spans`` (id, symbol, start, end, and optionally level, bullish, after) with what the bars say.

    ``after`` is the bar from which confirmation counts (default: the one after the
    end), ``level`` and ``bullish`` a level and the side on which it is confirmed: by
    a close 3 % beyond it, or three closes in a row beyond it. Spans are cut to the
    history; one that lies outside it has no row.
    """
    for name, kind in (("level", "double"), ("bullish", "boolean"), ("after", "int")):
        if name not in spans.columns:
            spans = spans.withColumn(name, F.lit(None).cast(kind))
    last = with_index(bars).groupBy("symbol").agg(F.max("bar_idx").alias("last_idx"))
    spans = spans.join(last, "symbol").withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", "last_idx")}).where("start <= end")
    (most,) = spans.agg(F.coalesce(F.max(F.col("end") - F.col("start") + 1), F.lit(1))).first()
    spans = spans.withColumns({"n": F.col("end") - F.col("start") + 1, "after": F.greatest(F.coalesce("after", F.col("end") + 1), F.lit(0))})
    spans = spans.withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int"))
    spans = spans.withColumn("second", (F.col("end") - F.pow(F.lit(2), F.col("k")) + 1).cast("int"))
    places = {"start": "start", "end": "end", "second": "second", "after": "after"}
    asks = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).cast("int").alias("bar_idx")) for role, c in places.items()]))
    asked = spans.select("id", "symbol", "k", asks.alias("ask")).select("id", "symbol", "k", "ask.role", "ask.bar_idx")
    bar = lookups(bars, most).select("symbol", "bar_idx", *KEPT[:-2], "highs", "lows")
    found = asked.join(bar, ["symbol", "bar_idx"])
    found = found.withColumns({"high": F.get("highs", "k"), "low": F.get("lows", "k")}).drop("highs", "lows")
    # plain columns: a hash takes them, and those that nobody asks for fall away
    met = found.groupBy("id").agg(*[F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{c}_at_{role}") for role in places for c in KEPT])
    return spans.join(met, "id").select("id", "symbol", "start", "end", "level", "bullish", "after", *told())


def told() -> list[Column]:
    end, start, second, after = ({c: F.col(f"{c}_at_{role}") for c in KEPT} for role in ("end", "start", "second", "after"))
    n, follow = F.col("n"), F.coalesce(after["to_last"], F.lit(0))
    strong = F.when(F.col("bullish"), after["high_after"] >= F.col("level") * (1 + FAR)).otherwise(after["low_after"] <= F.col("level") * (1 - FAR))
    steady = F.when(F.col("bullish"), after["held_above"] > F.col("level")).otherwise(after["held_below"] < F.col("level"))
    reach = F.when(F.col("bullish"), after["high_after"] / F.col("level") - 1).otherwise(1 - after["low_after"] / F.col("level"))
    usable = (F.col("level") > 0) & F.col("bullish").isNotNull() & (follow > 0)
    return [
        n.cast("long").alias("bar_count"),
        (end["bulls"] - start["bulls"] + start["is_bull"]).alias("bullish_bar_count"),
        (end["bears"] - start["bears"] + start["is_bear"]).alias("bearish_bar_count"),
        F.least(end["bull_run"], n).cast("long").alias("consecutive_bullish_bars"),
        F.least(end["bear_run"], n).cast("long").alias("consecutive_bearish_bars"),
        F.greatest(start["high"], second["high"]).alias("highest"),
        F.least(start["low"], second["low"]).alias("lowest"),
        follow.cast("long").alias("post_confirmation_bars"),
        ((follow >= 2) & F.coalesce(after["all_fall"], F.lit(False))).alias("continuation_down"),
        ((follow >= 2) & F.coalesce(after["all_rise"], F.lit(False))).alias("continuation_up"),
        F.when(usable & strong, "distance").when(usable & F.coalesce(steady, F.lit(False)), "three closes").otherwise("none").alias("confirmation"),
        F.when(usable, reach * 100).otherwise(0.0).alias("distance_pct"),
    ]


def history_evidence(bars: DataFrame) -> DataFrame:
    """One row a symbol with at least five bars: trend, place in the range, ATR, volume, gaps, large bodies, shadows, shrinking, last runs.

    Of each history only the last 60 bars stand in an array; extremes, gaps and the
    last gap's fill are aggregates over all of it.
    """
    rows = with_index(bars).withColumns({"ph": F.lag("high").over(ordered()), "pl": F.lag("low").over(ordered()), "pc": F.coalesce(F.lag("close").over(ordered()), F.col("close"))})
    up, down = F.coalesce(F.col("low") > F.col("ph") * 1.001, F.lit(False)), F.coalesce(F.col("high") < F.col("pl") * 0.999, F.lit(False))
    rows = rows.withColumns({"gap": F.when(up, "up").when(down, "down"), "fill": F.when(up, F.col("ph")).when(down, F.col("pl"))})
    rows = rows.withColumn("last_idx", F.max("bar_idx").over(Window.partitionBy("symbol")))
    last_gap = F.max(F.when(F.col("gap").isNotNull(), F.struct("bar_idx", "gap", "fill")))
    whole = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bar_count"), F.min("close").alias("least"), F.max("close").alias("most"), F.count_if(F.col("gap") == "up").alias("up_gap_count"),
        F.count_if(F.col("gap") == "down").alias("down_gap_count"), last_gap.alias("last_gap"),
        F.array_sort(F.collect_list(F.when(F.col("bar_idx") > F.col("last_idx") - 60, F.struct("bar_idx", "open", "high", "low", "close", "volume", "pc", "gap")))).alias("tail"),
    )
    later = rows.join(whole.select("symbol", "last_gap"), "symbol").where("bar_idx > last_gap.bar_idx")
    filled = later.groupBy("symbol").agg(F.max(F.when(F.col("last_gap.gap") == "up", F.col("low") <= F.col("last_gap.fill")).otherwise(F.col("high") >= F.col("last_gap.fill"))).alias("filled"))
    rows = whole.where("bar_count >= 5").join(filled, "symbol", "left")
    o, h, x, c, v, pc = (F.col(f"tail.{n}") for n in ("open", "high", "low", "close", "volume", "pc"))
    each = lambda f: F.transform("tail", f)
    arrays = {
        "close_": c, "body": each(lambda b: F.abs(b["close"] - b["open"])), "range": each(lambda b: F.greatest(b["high"] - b["low"], F.lit(TINY))),
        "upper": each(lambda b: b["high"] - F.greatest(b["open"], b["close"])), "lower": each(lambda b: F.least(b["open"], b["close"]) - b["low"]),
        "move": each(lambda b: b["close"] / b["pc"] - 1), "sized": each(lambda b: F.abs(b["close"] - b["open"]) / F.greatest(b["close"], F.lit(TINY)) * 100),
        "true": each(lambda b: F.greatest(b["high"] - b["low"], F.abs(b["high"] - b["pc"]), F.abs(b["low"] - b["pc"]))), "volume_": v,
        "way": each(lambda b: F.signum(b["close"] - b["open"])),
    }
    rows = rows.withColumns(arrays)
    logs = F.transform("close_", lambda p: F.ln(p))
    rows = rows.withColumns({"fit": A.line(A.span(F.lit(0), F.size("close_") - 1), logs), "now": F.get("close_", F.size("close_") - 1), "was": F.get("close_", F.size("close_") - 2)})
    shadows = F.transform(F.arrays_zip("upper", "lower", "range"), lambda s: (s["upper"] + s["lower"]) / s["range"])
    rows = rows.withColumns({"slope": F.expm1(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("fit.slope") * 252))), "shadow": shadows})
    recent = A.newest(F.col("shadow"), 30)
    rows = rows.withColumn("limit", F.greatest(F.lit(0.35), quantile(recent, 0.65))).withColumn("large", F.greatest(F.lit(2.5), A.median(A.newest(F.col("sized"), 20)) * 2.5))
    share = lambda values, test: F.size(F.filter(A.newest(values, 10), test)) / F.least(F.lit(10), F.size(values))
    fraction = lambda name: F.zip_with(name, "range", lambda s, r: s / r)
    ten = lambda sign: F.size(F.filter(A.newest(F.arrays_zip("move", "sized"), 10), lambda b: (b["move"] * sign > 0) & (b["sized"] >= F.col("large"))))
    trend = F.when((F.col("slope") > 0.08) & (F.col("fit.r2") > 0.25), "up").when((F.col("slope") < -0.08) & (F.col("fit.r2") > 0.25), "down").otherwise("range")
    shrink = lambda name: F.coalesce(F.try_divide(A.median(A.newest(F.col(name), 3)), F.greatest(A.median(A.piece(F.col(name), F.size(name) - 13, F.size(name) - 4)), F.lit(TINY))), F.lit(1.0))
    run = lambda sign: F.size(F.col("way")) - 1 - F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.size("way") - 1), lambda i: F.get("way", i) != sign)), F.lit(-1))
    rows = rows.withColumns({"trend": trend, "bull_run": run(1.0), "bear_run": run(-1.0), "atr": A.mean(A.newest(F.col("true"), 14))})
    return rows.select(
        "symbol", "bar_count", "trend", F.col("slope").alias("trend_slope"), F.col("fit.r2").alias("trend_r2"),
        ((F.col("now") - F.col("least")) / F.greatest(F.col("most") - F.col("least"), F.lit(TINY))).alias("position_pct"), "atr", (F.col("atr") / F.col("now") * 100).alias("atr_pct"),
        F.coalesce(F.try_divide(F.get("volume_", F.size("volume_") - 1), A.mean(A.newest(F.col("volume_"), 20))), F.lit(1.0)).alias("volume_ratio"),
        share(F.col("shadow"), lambda s: s >= F.col("limit")).alias("shadow_frequency"), share(fraction("upper"), lambda s: s >= 0.2).alias("upper_shadow_frequency"),
        share(fraction("lower"), lambda s: s >= 0.2).alias("lower_shadow_frequency"), shrink("body").alias("body_shrink_ratio"), shrink("range").alias("range_shrink_ratio"),
        (F.col("up_gap_count") + F.col("down_gap_count")).alias("gap_count"), "up_gap_count", "down_gap_count",
        F.coalesce(F.get("tail", F.size("tail") - 1)["gap"], F.lit("none")).alias("last_gap_direction"), F.coalesce("filled", F.lit(False)).alias("last_gap_filled"),
        ten(1).cast("long").alias("big_bullish_count_10"), ten(-1).cast("long").alias("big_bearish_count_10"),
        ((F.col("now") / F.get("close_", F.greatest(F.size("close_") - 20, F.lit(0))) - 1) * 100).alias("recent_return_pct"),
        F.size(F.filter(A.newest(F.col("way"), 5), lambda w: w > 0)).cast("long").alias("bullish_bar_count"), F.size(F.filter(A.newest(F.col("way"), 5), lambda w: w < 0)).cast("long").alias("bearish_bar_count"),
        F.col("bull_run").cast("long").alias("consecutive_bullish_bars"), F.col("bear_run").cast("long").alias("consecutive_bearish_bars"),
        ((F.col("trend") == "down") & (F.col("bear_run") >= 2) & (F.col("now") < F.col("was"))).alias("continuation_down"),
        ((F.col("trend") == "up") & (F.col("bull_run") >= 2) & (F.col("now") > F.col("was"))).alias("continuation_up"),
    )


def quantile(values: Column, share: float) -> Column:
    """Linear between the two nearest of the sorted values."""

    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * share
        low = F.get(s, F.floor(at).cast("int"))
        return low + (F.get(s, F.ceil(at).cast("int")) - low) * (at - F.floor(at))

    return A.let(F.array_sort(values), between)
