"""Patterns of many candles: slow trends, stalls, towers, probes, rounding, acceleration.

Each bar gets the bars from it to 29 further on as one array, whose elements also
carry running sums, so that a count, slope or R2 of any stretch costs a few
subtractions. A detector looks for the first end of a stretch that starts at the bar.
All is one window over the shared order and array functions: no join, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ordered, sma

LONGEST = 30
#: Patterns whose overlapping or touching stretches become one, and those of which a symbol keeps the first three.
MERGED = ("gradual_rise", "gradual_decline", "steady_rise", "steady_decline", "rising_resistance", "falling_resistance")
FIRST_THREE = (*MERGED, "slow_rise", "slow_decline", "acceleration")
EVENT = "array<struct<pattern:string,direction:string,start_idx:int,end_idx:int,confidence:double,note:string>>"


def features(bars: DataFrame) -> DataFrame:
    w = ordered()
    rows = bars.select("symbol", "ts", F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), (F.row_number().over(w) - 1).alias("j"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"))
    rows = rows.withColumns({"b": F.abs(F.col("c") - F.col("o")), "r": F.col("h") - F.col("l"), "us": F.col("h") - F.greatest("o", "c"), "ls": F.least("o", "c") - F.col("l")})
    rows = rows.withColumns({"mb": sma(F.col("b"), 20, 5), "mr": sma(F.col("r"), 20, 5), "mc": sma(F.col("c"), 20, 5), "bull": (F.col("c") > F.col("o")).cast("int"), "bear": (F.col("c") < F.col("o")).cast("int")})
    flag = lambda condition: F.coalesce(F.expr(condition).cast("int"), F.lit(0))
    two_back = lambda c: F.col(c) * F.coalesce(F.lag(c, 1).over(w), F.lit(0)) * F.coalesce(F.lag(c, 2).over(w), F.lit(0))
    rows = rows.withColumns({
        "small": flag("b < 0.8 * mb"), "large": flag("b > 2 * mb"), "middle": flag("b >= 0.8 * mb and b < 2 * mb"), "above": flag("b > 0.8 * mb"), "strong": flag("b > 1.5 * mb"), "classes": flag("b / nullif(mb, 0) <= 0.08"),
        "bulls3": two_back("bull"), "bears3": two_back("bear"), "up_share": F.coalesce(F.try_divide("us", "r"), F.lit(0.0)), "low_share": F.coalesce(F.try_divide("ls", "r"), F.lit(0.0)),
        "y": F.col("c"), "xy": F.col("j") * F.col("c"), "yy": F.col("c") * F.col("c"), "prior": F.try_divide(F.lag("c").over(w), F.coalesce(F.lag("c", 12).over(w), F.first("c").over(w))) - 1,
    })
    return rows


SUMMED = ("small", "large", "middle", "above", "strong", "bull", "bear", "bulls3", "bears3", "up_share", "low_share", "y", "xy", "yy")
PLAIN = ("o", "h", "l", "c", "b", "r", "us", "ls", "mb", "mr", "mc", "bull", "bear", "strong", "above")


class Stretch:
    """The bars from one bar on, as an array ``w``, with the bar's own place and the length of the history."""

    def __init__(self) -> None:
        self.w, self.left = F.col("w"), F.col("n") - F.col("j")

    def at(self, k: Column | int, name: str) -> Column:
        return F.get(self.w, F.lit(k) if isinstance(k, int) else k)[name]

    def total(self, name: str, last: Column | int, first: Column | int = 0) -> Column:
        return self.at(last, f"s_{name}") - self.at(first, f"s_{name}") + self.at(first, f"v_{name}")

    def ends(self, low: int, high: int, condition: Callable[[Column], Column]) -> Column:
        """The first k from low to high for which the condition holds, as an array."""
        return F.slice(F.filter(F.sequence(F.lit(low), F.lit(high)), lambda k: (k < F.size(self.w)) & F.coalesce(condition(k), F.lit(False))), 1, 1)

    def slope_and_fit(self, k: Column) -> tuple[Column, Column]:
        m = (k + 1).cast("double")
        sx, sxx, sy, yy = m * (m - 1) / 2, m * (m - 1) * (2 * m - 1) / 6, self.total("y", k), self.total("yy", k)
        xy = self.total("xy", k) - F.col("j") * sy
        top, under, over = m * xy - sx * sy, m * sxx - sx * sx, m * yy - sy * sy
        return top, F.coalesce(F.try_divide(top * top, under * over), F.lit(0.0))

    def extreme(self, name: str, k: Column, largest: bool) -> Column:
        """Of the bars between the first and bar k."""
        inner = F.transform(F.slice(self.w, F.lit(2), k - 1), lambda x: x[name])
        return F.array_max(inner) if largest else F.array_min(inner)


def event(pattern: str, direction: str, k: Column, confidence: Column, note: Column | None = None) -> Column:
    return F.struct(F.lit(pattern).alias("pattern"), F.lit(direction).alias("direction"), F.col("j").cast("int").alias("start_idx"), (F.col("j") + k).cast("int").alias("end_idx"), confidence.cast("double").alias("confidence"), (note if note is not None else F.lit(None).cast("string")).alias("note"))


def detectors(s: Stretch) -> list[Column]:
    """One array of events for each detector and direction."""
    out: list[Column] = []
    for up in (True, False):
        with_it, against = ("bull", "bear") if up else ("bear", "bull")
        side = with_it
        name = lambda a, b: a if up else b  # noqa: B023, E731
        rises = lambda k: s.slope_and_fit(k)[0] > 0 if up else s.slope_and_fit(k)[0] < 0  # noqa: B023, E731
        fits = lambda k: rises(k) & (s.slope_and_fit(k)[1] >= 0.3)  # noqa: B023, E731
        fit = lambda k: s.slope_and_fit(k)[1]

        gradual = lambda k: (s.total("small", k) >= 0.7 * (k + 1)) & (s.total("large", k) == 0) & (s.total(with_it, k) >= 0.7 * (k + 1)) & fits(k)  # noqa: B023, E731
        out.append(F.transform(s.ends(8, 29, gradual), lambda k: event(name("gradual_rise", "gradual_decline"), side, k, fit(k))))  # noqa: B023

        no_run = lambda k: s.total(f"{against}s3", k, 2) == 0  # noqa: B023, E731
        steady = lambda k: (s.total("middle", k) >= 0.6 * (k + 1)) & (s.total(with_it, k) >= 0.6 * (k + 1)) & no_run(k) & fits(k)  # noqa: B023, E731
        out.append(F.transform(s.ends(6, 29, steady), lambda k: event(name("steady_rise", "steady_decline"), side, k, fit(k))))  # noqa: B023

        shares = "up_share" if up else "low_share"
        pressed = lambda k: s.total(shares, k) / (k + 1) >= 0.22  # noqa: B023, E731
        progress = lambda k: (s.at(k, "c") - s.at(0, "c")) / F.greatest(F.abs(s.at(0, "c")), F.lit(1e-9))
        shrunk = lambda k: s.at(k, "b") + s.at(k - 1, "b") <= 0.85 * (s.at(0, "b") + s.at(1, "b"))
        stalls = lambda k: (s.total("bull", k) > 0) & (s.total("bear", k) > 0) & (progress(k).between(-0.025, 0.035) if up else progress(k).between(-0.035, 0.025)) & (shrunk(k) | pressed(k))  # noqa: B023, E731
        ahead = (F.col("j") >= 6) & ((F.col("prior") >= 0.025) if up else (F.col("prior") <= -0.025))
        held = lambda k: F.least(F.lit(0.92), 0.60 + F.least(F.abs("prior"), F.lit(0.12)) + 0.08 * F.least(s.total("bull", k), s.total("bear", k)) / (k + 1) + F.when(pressed(k), 0.08).otherwise(0.0))  # noqa: B023, E731
        found = F.transform(s.ends(4, 11, stalls), lambda k: event(name("rising_resistance", "falling_resistance"), against, k, held(k)))  # noqa: B023
        out.append(F.when(ahead, found).otherwise(F.array().cast(EVENT)))

        last = lambda p: F.least(p + 2, (s.left - 1).cast("int"))
        slow = lambda p: (p < s.left - 1) & (s.total("above", p - 1) <= 0.3 * p) & (s.total(with_it, p - 1) >= 0.7 * p) & (s.total("strong", last(p), p) == last(p) - p + 1) & (s.total(with_it, last(p), p) == last(p) - p + 1) & fits(last(p))  # noqa: B023, E731
        found = F.transform(s.ends(5, 14, slow), lambda p: event(name("slow_rise", "slow_decline"), side, last(p), fit(last(p)), (F.col("j") + p).cast("string")))  # noqa: B023
        out.append(F.when(s.left > 8, found).otherwise(F.array().cast(EVENT)))

        beyond = lambda k: s.at(k, "c") > s.extreme("h", k, True) if up else s.at(k, "c") < s.extreme("l", k, False)  # noqa: B023, E731
        turn = lambda k: (s.at(0, against) == 1) & (s.at(k, with_it) == 1) & (k < s.left - 1) & beyond(k)  # noqa: B023, E731
        pagoda = lambda k: turn(k) & (s.at(k, "b") > s.at(k, "mb")) & F.coalesce(s.at(0, "b") >= s.at(0, "mb"), F.lit(True)) & (s.extreme("h", k, True) - s.extreme("l", k, False) < 2 * s.at(0, "b"))  # noqa: B023, E731
        out.append(F.when(s.left > 5, F.transform(s.ends(4, 14, pagoda), lambda k: event(name("pagoda_bottom", "pagoda_top"), "neutral", k, F.lit(0.6)))).otherwise(F.array().cast(EVENT)))  # noqa: B023

        room = lambda k: F.when(s.at(k, "mr") > 0, s.at(k, "mr")).otherwise(F.greatest(s.extreme("h", k, True) - s.extreme("l", k, False), F.lit(1e-12)))
        calm = lambda k: (s.at(k, "o") <= s.extreme("h", k, True) + 0.60 * room(k)) & (s.at(k, "c") - s.extreme("h", k, True) <= F.greatest(1.80 * room(k), 0.04 * F.abs(s.at(k, "c")))) if up else F.lit(True)  # noqa: B023, E731
        tower = lambda k: turn(k) & (s.at(0, "strong") == 1) & (s.at(k, "strong") == 1) & (s.total("above", k - 1, 1) == 0) & (s.extreme("h", k, True) <= s.at(0, "h")) & (s.extreme("l", k, False) >= s.at(0, "l")) & calm(k)  # noqa: B023, E731
        kind = lambda k: F.when(s.extreme("h", k, True) - s.extreme("l", k, False) < 0.5 * s.at(1, "mr"), "classic").otherwise("variant")
        out.append(F.when(s.left > 5, F.transform(s.ends(4, 9, tower), lambda k: event(name("tower_bottom", "tower_top"), side, k, F.lit(1.0), kind(k)))).otherwise(F.array().cast(EVENT)))  # noqa: B023

        shadow = "us" if up else "ls"
        keeps = lambda k: s.extreme("l", k, False) >= s.at(0, "o") if up else s.extreme("h", k, True) <= s.at(0, "o")  # noqa: B023, E731
        margin = lambda k: 0.3 * F.try_divide(s.at(k, "mr"), s.at(k, "mc"))
        breaks = lambda k: s.at(k, "c") > s.at(0, "h") * (1 + margin(k)) if up else s.at(k, "c") < s.at(0, "l") * (1 - margin(k))  # noqa: B023, E731
        ordered_after = lambda k: F.forall(F.sequence(k + 1, k + 4), lambda q: s.at(q, "c") <= s.at(q + 1, "c") if up else s.at(q, "c") >= s.at(q + 1, "c"))  # noqa: B023, E731
        confirmed = lambda k: (k + 5 < s.left) & (ordered_after(k) | (s.at(k + 5, "c") >= s.at(k, "c") if up else s.at(k + 5, "c") <= s.at(k, "c")))  # noqa: B023, E731
        probe = lambda k: keeps(k) & (s.at(k, with_it) == 1) & (F.coalesce(F.try_divide(s.at(k, shadow), s.at(k, "r")), F.lit(1.0)) < 0.10) & breaks(k) & confirmed(k)  # noqa: B023, E731
        first = (s.left > 8) & (s.at(0, with_it) == 1) & F.coalesce(s.at(0, "b") >= s.at(0, "mb"), F.lit(True)) & (F.try_divide(s.at(0, shadow), s.at(0, "r")) > 0.5)
        out.append(F.when(first, F.transform(s.ends(3, 9, probe), lambda k: event(name("bullish_probe", "bearish_probe"), side, k, F.lit(1.0)))).otherwise(F.array().cast(EVENT)))  # noqa: B023
    return out


def rounding(s: Stretch) -> Column:
    """Flat stretches whose middle lies on one side of the line through them."""

    def shape(k: Column) -> Column:
        m = (k + 1).cast("double")
        slope = s.slope_and_fit(k)[0] / (m * (m * (m - 1) * (2 * m - 1) / 6) - (m * (m - 1) / 2) * (m * (m - 1) / 2))
        level = s.total("y", k) / m - slope * (m - 1) / 2
        off = F.transform(F.slice(s.w, F.lit(1), k + 1), lambda x, i: x["c"] - level - slope * i)
        spread = F.sqrt(F.aggregate(off, F.lit(0.0), lambda a, x: a + x * x) / m)
        closes = F.transform(F.slice(s.w, F.lit(1), k + 1), lambda x: x["c"])
        place = lambda best: (F.array_position(closes, best) - 1) / m
        low = (place(F.array_min(closes)) > 0.3) & (place(F.array_min(closes)) < 0.7) & (off[0] > 0) & (F.get(off, k) > 0) & (F.array_min(off) < -spread)
        high = (place(F.array_max(closes)) > 0.3) & (place(F.array_max(closes)) < 0.7) & (off[0] < 0) & (F.get(off, k) < 0) & (F.array_max(off) > spread)
        return F.when(F.abs(slope) < 0.001, F.when(low, "round_bottom").when(high, "round_top"))

    found = s.ends(7, 26, lambda k: shape(k).isNotNull())
    return F.transform(found, lambda k: F.struct(shape(k).alias("pattern"), F.lit("neutral").alias("direction"), F.col("j").cast("int").alias("start_idx"), (F.col("j") + k).cast("int").alias("end_idx"), F.lit(0.6).alias("confidence"), F.lit(None).cast("string").alias("note")))


def acceleration(rows: DataFrame) -> DataFrame:
    """Five closes whose slope is 1.2 times that of the five before, with growing bodies, and a turn in the five after."""
    w = ordered()
    slope = F.regr_slope("c", "j").over(w.rowsBetween(-4, 0))
    wide = rows.select("symbol", "ts", "j", "n", "c", slope.alias("slope"), F.when(F.count("b").over(w.rowsBetween(-4, 0)) >= 3, F.avg("b").over(w.rowsBetween(-4, 0))).alias("body"), F.min("c").over(w.rowsBetween(1, 5)).alias("lowest"), F.max("c").over(w.rowsBetween(1, 5)).alias("highest"))
    wide = wide.withColumns({"before": F.when(F.col("j") >= 9, F.lag("slope", 5).over(w)).otherwise(0.0), "body2": F.lag("body", 2).over(w)})
    turned = F.when(F.col("slope") > 0, F.col("lowest") < F.col("c")).otherwise(F.col("highest") > F.col("c"))
    hits = wide.where((F.col("j") >= 5) & (F.col("j") < F.col("n") - 5) & (F.col("body") > F.col("body2")) & (F.abs("slope") > 1.2 * F.abs("before")) & turned)
    return hits.select("symbol", F.lit("acceleration").alias("pattern"), F.lit("neutral").alias("direction"), (F.col("j") - 4).cast("int").alias("start_idx"), F.col("j").cast("int").alias("end_idx"), F.lit(0.8).alias("confidence"), F.when(F.col("slope") > 0, "up").otherwise("down").alias("note"))


def detect(bars: DataFrame) -> DataFrame:
    """(symbol, pattern, direction, start_idx, end_idx, confidence, note) of all patterns of many bars."""
    w = ordered()
    rows = features(bars)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({f"s_{c}": F.sum(c).over(so_far) for c in SUMMED})
    element = F.struct(*PLAIN, *[F.col(f"s_{c}") for c in SUMMED], *[F.col(c).alias(f"v_{c}") for c in SUMMED])
    held = summed.select("symbol", "ts", "j", "n", "prior", F.collect_list(element).over(w.rowsBetween(0, LONGEST - 1)).alias("w"))
    s = Stretch()
    found = held.select("symbol", F.explode(F.concat(*detectors(s), rounding(s))).alias("e")).select("symbol", "e.*").unionByName(acceleration(rows))
    by = Window.partitionBy("symbol", "pattern").orderBy("start_idx", "end_idx")
    reached = F.max("end_idx").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("pattern").isin(*MERGED) & (F.col("start_idx") <= reached + 1), 0).otherwise(1)
    grouped = found.withColumn("new", new).withColumn("grp", F.sum("new").over(by))
    merged = grouped.groupBy("symbol", "pattern", "direction", "grp").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.max("confidence").alias("confidence"), F.min_by("note", "start_idx").alias("note"))
    return merged.where(~F.col("pattern").isin(*FIRST_THREE) | (F.col("grp") <= 3)).drop("grp")


def flat_levels(bars: DataFrame, lookback: int = 10) -> DataFrame:
    """(symbol, pattern, direction, start_idx, end_idx, level): three of ten bars or more at the window's extreme."""
    w = ordered()
    rows = features(bars).select("symbol", "ts", "j", "n", "h", "l", (0.003 * F.col("mr")).alias("room"))
    rows = rows.withColumn("w", F.collect_list(F.struct("j", "h", "l", "room")).over(w.rowsBetween(0, lookback - 1))).where(F.col("j") < F.col("n") - 2)

    def side(pattern: str, direction: str, name: str, best: Callable[[Column], Column]) -> Column:
        level = best(F.transform("w", lambda x: x[name]))
        near = F.transform(F.filter("w", lambda x: F.coalesce(F.abs(x[name] - level) <= x["room"], F.lit(False))), lambda x: x["j"])
        return F.when(F.size(near) >= 3, F.struct(F.lit(pattern).alias("pattern"), F.lit(direction).alias("direction"), F.array_min(near).alias("start_idx"), F.array_max(near).alias("end_idx"), level.alias("level")))

    both = F.array_compact(F.array(side("flat_bottom", "bull", "l", F.array_min), side("flat_top", "bear", "h", F.array_max)))
    return rows.select("symbol", F.explode(both).alias("e")).select("symbol", "e.*")
