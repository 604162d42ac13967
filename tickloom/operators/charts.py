"""Chart structures over frames: double and triple extremes, heads and shoulders, rounding, V, islands, cups, bases, triangles, wedges, boxes, flags.

Every rule is an expression of one frame (``swings.frames``): its bars and swings
are arrays of at most 120 entries. A rule gives signal structs or null, so all
rules of all frames run in one pass after the frames are grouped. Islands, whose
pairs of gaps are many, come from numpy over many frames at once, as swings do.

A signal's places are bar numbers of the history. Levels: a signal is confirmed if
the last close is 3 % beyond its level and, for daily bars, the last three bodies
and shadows shrink; it is a false break if the last close comes back over it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import at, deviation, let, line, mean, median, newest, on, parabola, piece, place_of_least, place_of_most, span
from .swings import flat_of, frames, matrices, with_swings

POINT = "struct<place:int,price:double,role:string>"
LINE = "struct<role:string,x1:int,y1:double,x2:int,y2:double>"
ARC = "struct<role:string,first:int,last:int,a:double,b:double,c:double>"
SIGNAL = (
    f"struct<pattern:string,family:string,direction:string,confidence:double,start:int,end:int,confirmed:boolean,false_break:boolean,"
    f"level:double,height:double,pivots:array<{POINT}>,lines:array<{LINE}>,arcs:array<{ARC}>>"
)


def point(place: Column, price: Column, role: str) -> Column:
    return F.struct((F.col("start_idx") + place).cast("int").alias("place"), price.alias("price"), F.lit(role).alias("role"))


def stroke(role: str, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    moved = F.col("start_idx")
    return F.struct(F.lit(role).alias("role"), (moved + x1).cast("int").alias("x1"), y1.alias("y1"), (moved + x2).cast("int").alias("x2"), y2.alias("y2"))


def arc(role: str, xs: Column, ys: Column) -> Column:
    """A parabola through or along points, in bar numbers."""
    moved = F.transform(xs, lambda x: x + F.col("start_idx"))

    def drawn(p: Column) -> Column:
        first, last = F.get(moved, F.lit(0)), F.get(moved, F.size(moved) - 1)
        return F.struct(F.lit(role).alias("role"), first.cast("int").alias("first"), last.cast("int").alias("last"), p["a"].alias("a"), p["b"].alias("b"), p["c"].alias("c"))

    return let(parabola(moved, ys), drawn)


def bulls(bullish: Column | bool) -> Column:
    return bullish if isinstance(bullish, Column) else F.lit(bullish)


def confirmed(level: Column, bullish: Column | bool) -> Column:
    beyond = F.when(bulls(bullish), F.col("now") >= level * 1.03).otherwise(F.col("now") <= level * 0.97)
    return beyond & F.col("calm")


def false_break(level: Column, bullish: Column | bool) -> Column:
    up = (F.col("before") > level) & (F.col("now") <= level)
    return F.when(bulls(bullish), up).otherwise((F.col("before") < level) & (F.col("now") >= level))


def signal(
    pattern: Column | str, family: str, bullish: Column | bool | None, confidence: Column, height: Column, level: Column | None,
    pivots: list[Column] | Column = (), lines: list[Column] | Column = (), arcs: list[Column] = (), sure: Column | None = None, broken: Column | None = None,
) -> Column:
    """A signal; its span is that of pivots and arcs, else of lines. ``bullish`` is None or null for neutral ones."""
    direction = F.lit("neutral") if bullish is None else F.when(bulls(bullish), "bullish").when(~bulls(bullish), "bearish").otherwise("neutral")
    pivots = pivots if isinstance(pivots, Column) else F.array(*pivots)
    lines = lines if isinstance(lines, Column) else F.array(*lines)
    pivots, lines, arcs = pivots.cast(f"array<{POINT}>"), lines.cast(f"array<{LINE}>"), F.array(*arcs).cast(f"array<{ARC}>")
    inner = F.concat(F.transform(pivots, lambda p: p["place"]), F.transform(arcs, lambda a: a["first"]), F.transform(arcs, lambda a: a["last"]))
    outer = F.concat(F.transform(lines, lambda x: x["x1"]), F.transform(lines, lambda x: x["x2"]))
    places = F.when(F.size(inner) > 0, inner).otherwise(outer)
    level = F.lit(None).cast("double") if level is None else level
    sure = F.lit(False) if sure is None else sure
    return F.struct(
        (F.lit(pattern) if isinstance(pattern, str) else pattern).alias("pattern"), F.lit(family).alias("family"), direction.alias("direction"),
        confidence.cast("double").alias("confidence"), F.array_min(places).alias("start"), F.array_max(places).alias("end"), sure.alias("confirmed"),
        (F.lit(False) if broken is None else broken).alias("false_break"), level.cast("double").alias("level"), height.alias("height"),
        pivots.alias("pivots"), lines.alias("lines"), arcs.alias("arcs"),
    ).cast(SIGNAL)


def shrinking(values: Column) -> Column:
    """Whether neither of the last two steps of three values is more than 8 % up from the value itself; null of fewer."""
    a, b, c = (at(values, F.size(values) - k) for k in (3, 2, 1))
    return (b - a <= F.greatest(a, F.lit(1e-12)) * 0.08) & (c - b <= F.greatest(b, F.lit(1e-12)) * 0.08)


def prior_trend(values: Column, first: Column, top: bool) -> Column:
    """Whether up to 32 closes before a place (6 at least) led to it: 4 % or 3 ATR, the slope of the same sign."""
    back = F.least(F.lit(32), first)

    def led(own: Column) -> Column:
        start = F.greatest(F.abs(median(F.slice(own, 1, 3))), F.lit(1e-12))
        move, slope = median(newest(own, 3)) / start - 1, line(span(F.lit(0), F.size(own) - 1), own)["slope"]
        needed = F.greatest(F.lit(0.04), 3 * F.col("atr") / start)
        return (move >= needed) & (slope > 0) if top else (move <= -needed) & (slope < 0)

    return F.coalesce((back >= 6) & let(piece(values, first - back, first), led), F.lit(False))


def followed(extremes: Column, neck: Column, top: bool) -> Column:
    """Whether the last close is a quarter of the depth off the extremes and has not passed them."""

    def off(middle: Column) -> Column:
        depth, margin = F.abs(middle - neck), F.greatest(F.col("atr") * 0.35, F.abs(middle) * 0.003)
        deep = depth >= F.greatest(F.col("atr") * 2, F.abs(middle) * 0.025)
        if top:
            return deep & (F.col("now") <= F.array_max(extremes) + margin) & (F.col("now") <= middle - depth * 0.25)
        return deep & (F.col("now") >= F.array_min(extremes) - margin) & (F.col("now") >= middle + depth * 0.25)

    return let(mean(extremes), off)


def alike(values: Column, most: float) -> Column:
    return (F.array_max(values) - F.array_min(values)) / F.greatest(F.abs(mean(values)), F.lit(1e-12)) <= most


def multiple(n: int, top: bool) -> Column:
    """A double (n = 2) or triple extreme of the last swings of one side."""
    suffix, own, other = ("top", "peak_points", "low") if top else ("bottom", "trough_points", "high")
    chosen = newest(F.col(own), n)

    def made(points: Column) -> Column:
        first, last = F.get(points, F.lit(0)), F.get(points, F.lit(n - 1))
        prices = F.transform(points, lambda p: p["price"])
        between = piece(F.col(other), first["place"], last["place"])
        neck = F.array_min(between) if top else F.array_max(between)
        neck_place = first["place"] + (place_of_least(between) if top else place_of_most(between))

        def told(neck: Column) -> Column:
            sure = confirmed(neck, not top)
            ends = F.transform(points, lambda p: point(p["place"], p["price"], suffix))
            role = "neckline_low" if top else "neckline_high"
            pivots = F.concat(ends, F.array(point(neck_place, neck, role))) if n == 2 else ends
            fits = alike(prices, 0.06 if n == 2 else 0.08) & first["trend"] & followed(prices, neck, top)
            if n == 2:
                fits = fits & (last["place"] - first["place"] >= 5)
            confidence = F.lit(0.68 if n == 2 else 0.72) + F.when(sure, 0.12).otherwise(0.0)
            return F.when(fits, signal(
                f"{'double' if n == 2 else 'triple'}_{suffix}", "multiple_top_bottom", not top, confidence, F.abs(mean(prices) - neck), neck,
                pivots, [stroke("neckline", first["place"], neck, last["place"], neck)], sure=sure, broken=false_break(neck, not top),
            ))

        return let(neck, told)

    return F.when(F.size(own) >= n, let(chosen, made))


def heads(top: bool) -> Column:
    """Heads and shoulders among the last seven swings of one side: an array of signals."""
    suffix, own, other, sign = ("top", "peak_points", "trough_points", 1) if top else ("bottom", "trough_points", "peak_points", -1)

    def each(recent: Column) -> Column:
        n = F.size(recent)

        def one(s: Column) -> Column:
            left, head, right = (F.get(recent, s + k) for k in range(3))
            shoulders = (left["price"] + right["price"]) / 2
            level_ends = F.abs(left["price"] - right["price"]) / F.greatest(F.abs(shoulders), F.lit(1e-12)) <= 0.10
            outer = F.greatest(left["price"], right["price"]) * 1.03 if top else F.least(left["price"], right["price"]) * 0.97
            sticks_out = head["price"] > outer if top else head["price"] < outer

            def inner(a: Column, b: Column) -> Column:
                """The deepest opposite swing between two places, the first of equal ones."""
                within = F.filter(other, lambda p: (p["place"] > a["place"]) & (p["place"] < b["place"]))
                ordered = F.array_sort(F.transform(within, lambda p: F.struct((p["price"] * sign).alias("key"), p["place"].alias("place"), p["price"].alias("price"))))
                return F.get(ordered, F.lit(0))

            def told(neck: Column) -> Column:
                a, b = neck["a"], neck["b"]
                slope = (b["price"] - a["price"]) / (b["place"] - a["place"])
                level = a["price"] + slope * (F.col("length") - 1 - a["place"])
                height = F.abs(head["price"] - (a["price"] + slope * (head["place"] - a["place"])))
                like = F.filter(recent, lambda p: (p["place"] != head["place"]) & (F.abs(p["price"] - shoulders) / F.greatest(F.abs(shoulders), F.lit(1e-12)) <= 0.14))
                compound, sure = (F.size(like) >= 3) | (s + 3 < n), confirmed(level, not top)
                pivots = [
                    point(left["place"], left["price"], "left_shoulder"), point(a["place"], a["price"], "neckline_left"), point(head["place"], head["price"], "head"),
                    point(b["place"], b["price"], "neckline_right"), point(right["place"], right["price"], "right_shoulder"),
                ]
                three = F.array(*[p["place"].cast("double") for p in (left, head, right)]), F.array(left["price"], head["price"], right["price"])
                confidence = F.least(F.lit(0.96), F.lit(0.80) + F.when(compound, 0.04).otherwise(0.0) + F.when(sure, 0.12).otherwise(0.0))
                name = F.concat(F.when(compound, "compound_").otherwise(""), F.lit(f"head_and_shoulders_{suffix}"))
                high_enough = height >= F.greatest(F.col("atr") * 2.5, F.abs(head["price"]) * 0.03)
                return F.when(high_enough, signal(
                    name, "head_and_shoulders", not top, confidence, height, level, pivots,
                    [stroke("neckline", a["place"], a["price"], b["place"], b["price"])], [arc("head_shoulders_bracket", *three)], sure, false_break(level, not top),
                ))

            neck = F.struct(inner(left, head).alias("a"), inner(head, right).alias("b"))
            both = let(neck, lambda n: F.when(n["a"].isNotNull() & n["b"].isNotNull(), told(n)))
            return F.when(left["trend"] & level_ends & sticks_out, both)

        return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), one)).otherwise(F.array().cast(f"array<{SIGNAL}>"))

    return let(newest(F.col(own), 7), each)


def flanks(vertex: Column, width: Column) -> Column:
    """Lines over the closes up to ``width`` bars on either side of a place, with the outer places and closes."""
    left, right = F.greatest(F.lit(0), vertex - width), F.least(F.col("length") - 1, vertex + width)
    return let(F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"), vertex.cast("int").alias("vertex")), lambda e: F.struct(
        e["left"].alias("left"), e["right"].alias("right"), e["vertex"].alias("vertex"),
        at(F.col("close"), e["left"]).alias("y_left"), at(F.col("close"), e["vertex"]).alias("y"), at(F.col("close"), e["right"]).alias("y_right"),
        line(span(e["left"], e["vertex"]), piece(F.col("close"), e["left"], e["vertex"])).alias("falls"),
        line(span(e["vertex"], e["right"]), piece(F.col("close"), e["vertex"], e["right"])).alias("rises"),
    ))


def turned(e: Column, bottom: Column | bool, fit: float, strict: bool) -> Column:
    """Whether both flanks move at least 2 ATR or 3 %, in the right directions, with fits of ``fit``."""
    a, b = e["falls"]["slope"], e["rises"]["slope"]
    right = F.when(bulls(bottom), (a < 0) & (b > 0)).otherwise((a > 0) & (b < 0))
    least = F.greatest(F.col("atr") * 2, F.abs(e["y"]) * 0.03)
    clear = (F.abs(e["y"] - e["y_left"]) >= least) & (F.abs(e["y_right"] - e["y"]) >= least)
    worse = F.least(e["falls"]["r2"], e["rises"]["r2"])
    return right & clear & (worse > fit if strict else worse >= fit)


def rounding() -> Column:
    """A parabola over the frame's closes, in units of their deviation, with clear flanks about its vertex."""
    last = F.col("length") - 1
    scale = F.struct(mean(F.col("close")).alias("m"), F.greatest(deviation(F.col("close")), F.lit(1e-12)).alias("s"))
    ys = let(scale, lambda k: F.transform("close", lambda c: (c - k["m"]) / k["s"]))
    xs = F.transform(span(F.lit(0), last), lambda x: x / last)

    def told(p: Column) -> Column:
        bottom, turn = p["a"] > 0, F.try_divide(-p["b"], 2 * p["a"])
        vertex = F.least(last, F.greatest(F.lit(0), F.bround(turn * last).cast("int")))

        def made(e: Column) -> Column:
            level = F.when(bottom, F.array_max("close")).otherwise(F.array_min("close"))
            fits = turned(e, bottom, 0.30, False)
            name = F.when(bottom, "rounding_bottom").otherwise("rounding_top")
            confidence = F.least(F.lit(0.88), F.lit(0.55) + p["r2"] * 0.3)
            drawn = arc("rounding", span(F.lit(0), last), F.col("close"))
            return F.when(fits, signal(name, "rounding", bottom, confidence, F.array_max("high") - F.array_min("low"), level, arcs=[drawn], sure=confirmed(level, bottom), broken=false_break(level, bottom)))

        bent = (F.abs(p["a"]) > 0.7) & (p["r2"] > 0.55) & turn.between(0.20, 0.80)
        return F.when(bent, let(flanks(vertex, F.greatest(F.lit(6), F.least(F.floor(F.col("length") / 4), F.lit(20)))), made))

    return let(parabola(xs, ys), told)


def sharp_turn(bottom: bool) -> Column:
    """A V: one lowest (highest) place in the middle of the frame that price visited only once."""
    values, n = F.col("low" if bottom else "high"), F.col("length")
    place = place_of_least(values) if bottom else place_of_most(values)

    def told(e: Column) -> Column:
        extreme = at(values, e["vertex"])
        reach = F.greatest(F.col("atr") * 1.25, F.abs(extreme) * 0.015)
        near = F.filter(F.sequence(F.lit(0), n - 1), lambda i: at(values, i) <= extreme + reach if bottom else at(values, i) >= extreme - reach)

        def once(near: Column) -> Column:
            steps = F.zip_with(F.slice(near, 2, F.size(near)), near, lambda b, a: b - a)
            return ~F.exists(steps, lambda d: F.coalesce(d > 3, F.lit(False))) & (F.size(near) <= F.greatest(F.lit(5), F.floor(n / 12)))

        v = [stroke("left_leg", e["left"], e["y_left"], e["vertex"], e["y"]), stroke("right_leg", e["vertex"], e["y"], e["right"], e["y_right"])]
        fits = turned(e, bottom, 0.55, True) & let(near, once)
        whole = F.array_max("high") - F.array_min("low")
        return F.when(fits, signal("v_bottom" if bottom else "inverted_v_top", "v_reversal", bottom, F.lit(0.72), whole, None, [point(e["vertex"], e["y"], "vertex")], v, sure=F.lit(True)))

    width = F.greatest(F.lit(8), F.least(F.floor(n / 4), F.lit(24)))
    return let(place, lambda i: F.when((i > n * 0.2) & (i < n * 0.8), let(flanks(i, width), told)))


def standing(high: np.ndarray, low: np.ndarray, close: np.ndarray, rise: float, fall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b) of gaps up before a and down before b with nothing but the island between them, that no later close rises above; nearer pairs first."""
    n = low.shape[1]
    row, a = np.nonzero(low[:, 1:] > high[:, :-1] * rise)
    a += 1
    falls = np.zeros(low.shape, bool)
    falls[:, 1:] = high[:, 1:] < low[:, :-1] * fall
    after = np.maximum.accumulate(close[:, ::-1], axis=1)[:, ::-1]  # NaN if one is missing, which no pair outlives
    least, most, found = low[row, a], high[row, a], []
    for width in range(1, max(12, n // 3) + 1):
        held = (a + width < n) & (least > high[row, a - 1] * rise)  # a wider island is no higher
        row, a, least, most = row[held], a[held], least[held], most[held]
        if not len(row):
            break
        b = a + width
        fits = falls[row, b] & (least > np.fmax(high[row, a - 1], high[row, b]) * rise) & (after[row, b] <= most)
        found.append((row[fits], a[fits], b[fits]))
        least, most = np.fmin(least, low[row, b]), np.fmax(most, high[row, b])
    return tuple(np.concatenate([np.zeros(0, int), *x]).astype(int) for x in zip(*found)) if found else (np.zeros(0, int),) * 3


def islands_of(high: pa.Array, low: pa.Array, close: pa.Array) -> pa.Array:
    """Per frame the last island: of equal ends a top before a bottom, then the longest; null without one."""
    (highs, starts, sizes), (lows, *_), (closes, *_) = flat_of(high), flat_of(low), flat_of(close)
    best, first = np.full(len(sizes), -1), np.zeros(len(sizes), int)
    for of, at_ in matrices(starts, sizes, 2):
        h, x, c = highs[at_], lows[at_], closes[at_]
        for top, found in ((0, standing(-x, -h, -c, 0.999, 1.001)), (1, standing(h, x, c, 1.001, 0.999))):
            row, a, b = found
            order = np.lexsort((-a, b, row))  # a row's last place has its latest end and longest island
            row, a, b = of[row[order]], a[order], b[order]
            last = np.append(row[1:] != row[:-1], True)[: len(row)]
            row, a, rank = row[last], a[last], b[last] * 2 + top
            better = rank > best[row]
            best[row[better]], first[row[better]] = rank[better], a[better]
    parts = [pa.array(best % 2 == 1), pa.array(first.astype("int32")), pa.array((best // 2).astype("int32"))]
    return pa.StructArray.from_arrays(parts, ["top", "a", "b"], mask=pa.array(best < 0))


def with_islands(rows: DataFrame) -> DataFrame:
    return rows.withColumn("isle", F.arrow_udf(islands_of, "struct<top:boolean,a:int,b:int>")("high", "low", "close"))


def island() -> Column:
    """The last pair of opposite gaps with nothing but the island between them, that price has not come back through."""
    n, high, low, close = F.col("length"), F.col("high"), F.col("low"), F.col("close")

    def told(p: Column) -> Column:
        top = p["top"]
        level = F.when(top, F.array_min(piece(low, p["a"], p["b"] - 1))).otherwise(F.array_max(piece(high, p["a"], p["b"] - 1)))

        def made(level: Column) -> Column:
            later = piece(close, p["b"], n - 1)
            strong = F.exists(later, lambda c: F.when(top, c <= level * 0.97).otherwise(c >= level * 1.03))
            outside = F.transform(later, lambda c: F.when(top, c < level).otherwise(c > level))
            three = let(outside, lambda out: F.exists(F.sequence(F.lit(0), F.greatest(F.size(out) - 3, F.lit(0))), lambda i: at(out, i) & at(out, i + 1) & at(out, i + 2)))
            shrinks = F.coalesce((F.size(later) >= 3) & F.col("calm_bars"), F.lit(False))
            sure = F.coalesce(F.when(F.col("daily"), strong & shrinks).otherwise(strong | three), F.lit(False))
            name = F.when(top, "island_reversal_top").otherwise("island_reversal_bottom")
            ends = [point(p["a"], at(close, p["a"]), "island_start"), point(p["b"], at(close, p["b"]), "island_end")]
            return signal(name, "island", ~top, F.lit(0.84), F.array_max("high") - F.array_min("low"), level, ends, sure=sure)

        return let(level, made)

    return let(F.col("isle"), lambda p: F.when(p.isNotNull(), told(p)))


def cup() -> Column:
    """Two like rims about a deep bottom, then a short shallow handle at the right rim."""
    n, high, low, close, atr = (F.col(c) for c in ("length", "high", "low", "close", "atr"))
    handle = F.greatest(F.lit(6), F.least(F.floor(n / 8), F.lit(16))).cast("int")
    tail = n - handle
    left_end, first = F.greatest(F.lit(12), F.floor(n * 0.38)), F.greatest(F.lit(4), F.floor(n * 0.18))
    last = F.least(tail - 8, F.floor(n * 0.70))
    left = place_of_most(piece(high, F.lit(0), left_end - 1))
    bottom = first + place_of_least(piece(low, first, last - 1))
    right = let(bottom, lambda b: F.when(tail - (b + 4) >= 8, b + 4 + place_of_most(piece(high, b + 4, tail - 1))))
    sizes = F.struct(left.cast("int").alias("left"), bottom.cast("int").alias("bottom"), right.cast("int").alias("right"))

    def rims(c: Column) -> Column:
        a, b, deep = at(high, c["left"]), at(high, c["right"]), at(low, c["bottom"])
        rim = (a + b) / 2
        fits = (rim - deep >= atr * 2) & (F.abs(a - b) <= F.greatest(atr * 1.5, rim * 0.12)) & (deep < F.least(a, b) - atr) & (c["right"] - c["left"] + 1 >= 12)
        out = F.filter(F.sequence(c["right"] + 1, n - 1), lambda i: at(close, i) > rim + F.greatest(rim * 0.01, atr * 0.5))
        break_at = F.get(out, F.lit(0))
        end = F.when(break_at >= c["right"] + 4, break_at).otherwise(n)
        more = F.struct(a.alias("a"), b.alias("b"), deep.alias("deep"), rim.alias("rim"), end.alias("end"), F.greatest(end - handle, c["right"] + 1).alias("start"))
        return F.when(fits, let(more, lambda r: told(c, r)))

    def told(c: Column, r: Column) -> Column:
        end, start, rim, depth = r["end"] - 1, r["start"], r["rim"], r["rim"] - r["deep"]
        lows, highs, closes = (piece(v, start, end) for v in (low, high, close))
        slope = line(span(F.lit(0), F.size(closes) - 1), closes)["slope"]
        fits = (r["end"] - start >= 3) & (F.array_min(lows) >= rim - depth * 0.5) & (F.array_max(highs) <= rim + F.greatest(atr * 0.75, rim * 0.015)) & (slope <= atr * 0.25)
        support, sure = line(span(start, end), lows), confirmed(rim, True)
        lines = [stroke("rim_resistance", c["left"], r["a"], c["right"], r["b"]), stroke("handle_support", start, at(low, start), end, on(support, end))]
        pivots = [point(c["left"], r["a"], "left_rim"), point(c["bottom"], r["deep"], "cup_bottom"), point(c["right"], r["b"], "right_rim"), point(start, at(low, start), "handle_start")]
        drawn = arc("cup", span(c["left"], c["right"]), piece(close, c["left"], c["right"]))
        confidence = F.lit(0.64) + F.when(sure, 0.08).otherwise(0.0)
        return F.when(fits, signal("cup_with_handle", "cup_with_handle", True, confidence, depth, rim, pivots, lines, [drawn], sure, false_break(rim, True)))

    possible = (n >= 60) & (tail >= F.floor(n * 0.62)) & (last > first)
    return F.when(possible, let(sizes, lambda c: F.when(c["right"].isNotNull(), rims(c))))


def base() -> Column:
    """A long quiet base on less volume after a fall of 8 %, and the break out of it."""
    n, high, low, close, volume = (F.col(c) for c in ("length", "high", "low", "close", "volume"))
    start = F.greatest(F.lit(12), F.floor(n * 0.45)).cast("int")
    end = F.least(F.greatest(start + 20, n - F.greatest(F.lit(5), F.floor(n / 10))), n).cast("int") - 1

    def told(e: Column) -> Column:
        a, b = e["start"], e["end"]
        own, prior = piece(close, a, b), piece(close, F.lit(0), a - 1)
        top, floor = F.array_max(piece(high, a, b)), F.array_min(piece(low, a, b))
        fell = at(prior, F.size(prior) - 1) / F.greatest(at(prior, F.lit(0)), F.lit(1e-12)) - 1 <= -0.08
        narrow = top - floor <= F.greatest(F.col("atr") * 7, F.greatest(mean(own), F.lit(1e-12)) * 0.12)
        was, was_volume = deviation(prior), median(piece(volume, F.lit(0), a - 1))
        calm = (was <= 0) | (deviation(own) <= was * 0.80)
        quiet = (was_volume <= 0) | (median(piece(volume, a, b)) <= was_volume * 0.95)
        sure = confirmed(top, True)

        def bounds(role: str, values: Column, most: bool) -> tuple[Column, Column]:
            fit = line(span(a, b), piece(values, a, b))
            drawn = let(fit, lambda f: stroke(role, a, on(f, a), n - 1, on(f, n - 1)))
            ranked = F.array_sort(F.transform(F.sequence(a, b), lambda i: F.struct(at(values, i).alias("price"), i.alias("place"))))
            two = newest(ranked, 2) if most else F.slice(ranked, 1, 2)
            return drawn, F.transform(two, lambda p: point(p["place"], p["price"], role))

        (upper, tops), (lower, bottoms) = bounds("base_resistance", high, True), bounds("base_support", low, False)
        confidence, bullish = F.lit(0.58) + F.when(sure, 0.12).otherwise(0.0), F.when(sure, F.lit(True))
        told = signal("dormant_bottom", "base", bullish, confidence, top - floor, top, F.concat(tops, bottoms), [upper, lower], sure=sure, broken=false_break(top, True))
        return F.when(fell & narrow & calm & quiet, told)

    return F.when((n >= 48) & (end - start + 1 >= 20), let(F.struct(start.alias("start"), end.alias("end")), told))


def bounded(kind: str) -> Column:
    """Structures between two lines along the last four peaks and troughs (``kind`` consolidation) or a flag."""
    p, t = newest(F.col("peak_points"), 4), newest(F.col("trough_points"), 4)
    xs = lambda points: F.transform(points, lambda q: q["place"].cast("double"))
    ys = lambda points: F.transform(points, lambda q: q["price"])
    first, last = lambda q: F.get(q, F.lit(0))["place"], lambda q: F.get(q, F.size(q) - 1)["place"]

    def measured(k: Column) -> Column:
        p, t = k["p"], k["t"]
        parts = F.struct(
            p.alias("p"), t.alias("t"), line(xs(p), ys(p)).alias("upper"), line(xs(t), ys(t)).alias("lower"),
            F.least(first(p), first(t)).alias("start"), F.greatest(last(p), last(t)).alias("end"),
        )
        return let(parts, consolidation if kind == "consolidation" else flag)

    def drawn(k: Column) -> tuple[Column, list[Column]]:
        ends = [stroke(role, first(q), on(f, first(q)), last(q), on(f, last(q))) for role, q, f in (("resistance", k["p"], k["upper"]), ("support", k["t"], k["lower"]))]
        return F.concat(*[F.transform(q, lambda one, role=role: point(one["place"], one["price"], role)) for q, role in ((k["p"], "peak"), (k["t"], "trough"))]), ends

    def consolidation(k: Column) -> Column:
        atr, upper, lower = F.col("atr"), k["upper"], k["lower"]
        middle = mean(F.col("close"))
        off = lambda q, f: F.aggregate(q, F.lit(0.0), lambda held, one: held + F.abs(one["price"] - on(f, one["place"]))) / F.size(q) / F.greatest(atr, F.lit(1e-12))
        sides = F.array_sort(F.concat(F.transform(k["p"], lambda q: F.struct(q["place"].alias("at"), F.lit(0).alias("side"))), F.transform(k["t"], lambda q: F.struct(q["place"].alias("at"), F.lit(1).alias("side")))))
        waves = let(sides, lambda s: F.size(F.filter(F.zip_with(F.slice(s, 2, F.size(s)), s, lambda b, a: F.coalesce(b["side"] != a["side"], F.lit(False))), lambda x: x)))
        more = F.struct(
            (on(upper, k["start"]) - on(lower, k["start"])).alias("wide"), (on(upper, k["end"]) - on(lower, k["end"])).alias("narrow"),
            (F.abs(upper["slope"]) * F.greatest(F.lit(1), last(k["p"]) - first(k["p"]))).alias("upper_move"), (F.abs(lower["slope"]) * F.greatest(F.lit(1), last(k["t"]) - first(k["t"]))).alias("lower_move"),
            F.greatest(atr * 0.75, middle * 0.015).alias("flat"), F.greatest(atr * 1.25, middle * 0.018).alias("slanted"),
            F.greatest(off(k["p"], upper), off(k["t"], lower)).alias("off"), waves.alias("waves"), F.greatest(F.lit(1), k["end"] - k["start"]).alias("span"),
            on(upper, F.col("length") - 1).alias("above"), on(lower, F.col("length") - 1).alias("below"),
        )
        return let(more, lambda m: named(k, m))

    def named(k: Column, m: Column) -> Column:
        atr, now, upper, lower = F.col("atr"), F.col("now"), k["upper"], k["lower"]
        both = lambda n: (F.size(k["p"]) >= n) & (F.size(k["t"]) >= n)
        triangle = both(3) & (m["waves"] >= 5) & (m["span"] >= 20) & (m["wide"] >= atr * 3) & (m["narrow"] > 0) & (m["off"] <= 1.25)
        box = both(2) & (m["waves"] >= 3) & (m["span"] >= 12) & (m["wide"] >= atr * 2) & (m["narrow"] > 0) & (m["off"] <= 1.0)
        up_flat, low_flat = m["upper_move"] <= m["flat"], m["lower_move"] <= m["flat"]
        leaning, shut = triangle & ~up_flat & ~low_flat, m["narrow"] < m["wide"]
        closing = F.try_divide(m["wide"] - m["narrow"], F.greatest(F.abs(m["wide"]), atr)) >= 0.10
        a, b = upper["slope"], lower["slope"]
        name = (
            F.when(triangle & up_flat & ~low_flat & (b > 0) & (m["lower_move"] >= m["slanted"]) & (lower["r2"] >= 0.35) & (m["narrow"] <= m["wide"] * 0.90), "ascending_triangle")
            .when(triangle & low_flat & ~up_flat & (a < 0) & (m["upper_move"] >= m["slanted"]) & (upper["r2"] >= 0.35) & (m["narrow"] <= m["wide"] * 0.90), "descending_triangle")
            .when(leaning & (a < 0) & (b > 0) & shut & closing, "symmetrical_triangle")
            .when(leaning & (a > 0) & (b > 0) & shut, "rising_wedge")
            .when(leaning & (a < 0) & (b < 0) & shut, "falling_wedge")
            .when(box & up_flat & low_flat, "rectangle")
            .when(triangle & (m["narrow"] > m["wide"] * 1.25), "broadening_triangle")
        )
        way = lambda name: (
            F.when(name.isin("ascending_triangle", "falling_wedge"), True)
            .when(name.isin("descending_triangle", "rising_wedge", "broadening_triangle"), False)
            .when((name == "symmetrical_triangle") & (now > m["above"]), True)
            .when((name == "symmetrical_triangle") & (now < m["below"]), False)
        )
        return let(name, lambda name: F.when(name.isNotNull(), let(F.struct(name.alias("name"), way(name).alias("way")), lambda w: told(k, m, w))))

    def told(k: Column, m: Column, w: Column) -> Column:
        atr, now = F.col("atr"), F.col("now")
        left = (now > m["above"] + F.greatest(atr * 0.5, m["above"] * 0.01)) | (now < m["below"] - F.greatest(atr * 0.5, m["below"] * 0.01))
        way = F.coalesce(w["way"], F.when(left, now > m["above"]))

        def made(way: Column) -> Column:
            level = F.when(way, m["above"]).otherwise(m["below"])
            sure = F.when(w["way"].isNull(), left).otherwise(confirmed(level, way))
            broken = w["way"].isNotNull() & F.coalesce(false_break(level, way), F.lit(False))
            pivots, lines = drawn(k)
            confidence = F.lit(0.56) + 0.16 * F.least(k["upper"]["r2"], k["lower"]["r2"]) + F.when(sure, 0.1).otherwise(0.0)
            return signal(w["name"], "consolidation", way, confidence, F.greatest(m["wide"], m["narrow"]), level, pivots, lines, sure=sure, broken=broken)

        return let(way, made)

    def flag(k: Column) -> Column:
        n, close = F.col("length"), F.col("close")
        end = F.greatest(F.lit(5), F.floor(n / 4)).cast("int")
        impulse = at(close, end) - at(close, F.lit(0))
        after = line(span(F.lit(0), n - 1 - end), piece(close, end, n - 1))

        def flown(f: Column) -> Column:
            up, slope = f["impulse"] > 0, f["after"]["slope"]
            against = F.when(up, slope <= 0).otherwise(slope >= 0) & (F.abs(slope) < F.abs(f["impulse"]) / n)
            level = F.when(up, F.array_max(piece(F.col("high"), end, n - 1))).otherwise(F.array_min(piece(F.col("low"), end, n - 1)))
            sure, (pivots, lines) = confirmed(level, up), drawn(k)
            fits = (F.abs(f["impulse"]) >= F.col("atr") * 4) & (f["after"]["r2"] >= 0.25) & against
            name = F.when(up, "ascending_flag").otherwise("descending_flag")
            return F.when(fits, signal(name, "flag", up, F.lit(0.66) + F.when(sure, 0.12).otherwise(0.0), F.abs(f["impulse"]), level, pivots, lines, sure=sure, broken=false_break(level, up)))

        return let(F.struct(impulse.alias("impulse"), after.alias("after")), flown)

    enough = (F.size("peak_points") >= 2) & (F.size("trough_points") >= 2)
    return F.when(enough, let(F.struct(p.alias("p"), t.alias("t")), measured))


def prepared(rows: DataFrame, daily: bool) -> DataFrame:
    """Frames with swings as points (place, price, whether a trend led there) and what all rules ask of the last bars."""
    # of the last three bars only: each place of ``shrinking`` makes its array anew
    opens, highs, lows, closes = (newest(F.col(c), 3) for c in ("open", "high", "low", "close"))
    bodies = F.zip_with(closes, opens, lambda c, o: F.abs(c - o))
    shadows = F.zip_with(F.zip_with(highs, lows, lambda h, x: h - x), bodies, lambda r, b: F.greatest(r - b, F.lit(0.0)))

    def points(places: str, values: str, top: bool) -> Column:
        return F.transform(places, lambda i: F.struct(i.alias("place"), at(F.col(values), i).alias("price"), prior_trend(F.col("close"), i, top).alias("trend")))

    last = F.col("length") - 1
    calm = F.coalesce(shrinking(bodies) & shrinking(shadows), F.lit(False))
    return rows.withColumns({
        "peak_points": points("peaks", "high", True), "trough_points": points("troughs", "low", False), "now": at(F.col("close"), last), "before": at(F.col("close"), last - 1),
        "daily": F.lit(daily), "calm_bars": calm, "calm": calm if daily else F.lit(True),
    })


#: What each family's rules are, in the order in which signals of equal confidence stand.
RULES = {
    "multiple": lambda: [multiple(n, top) for top in (True, False) for n in (2, 3)],
    "heads": lambda: [heads(True), heads(False)],
    "turns": lambda: [rounding(), sharp_turn(True), sharp_turn(False), island()],
    "cups": lambda: [cup(), base()],
    "bounded": lambda: [bounded("consolidation"), bounded("flag")],
}


@cache
def built(name: str, jvm: int) -> list[Column]:
    """The rules of a family as columns, built once in a JVM: they name columns, not a table."""
    return RULES[name]()


def detect(bars: DataFrame, daily: bool = True, rules: tuple[str, ...] = tuple(RULES), **options) -> DataFrame:
    """symbol, end_idx, length and the fields of SIGNAL per signal of every frame (``options`` as in ``swings.frames``)."""
    rows = prepared(with_swings(frames(bars, **options)), daily)
    if "turns" in rules:
        rows = with_islands(rows)
    arrays = {}
    for name in rules:
        found = built(name, id(bars.sparkSession._jvm))
        arrays[name] = F.concat(*found) if name == "heads" else F.array(*found)
    signals = rows.withColumns(arrays).select("symbol", "end_idx", "length", F.explode(F.array_compact(F.concat(*arrays))).alias("s"))
    return signals.select("symbol", "end_idx", "length", "s.*")


def best(signals: DataFrame) -> DataFrame:
    """The surest signal of each family and end: ties go to the longer frame, then to the pattern's name and place."""
    order = [F.col("confirmed").desc(), F.round("confidence", 9).desc(), F.col("length").desc(), "pattern", "start", "end"]
    ranked = signals.withColumn("rank", F.row_number().over(Window.partitionBy("symbol", "end_idx", "family").orderBy(*order)))
    return ranked.where("rank = 1").drop("rank")
