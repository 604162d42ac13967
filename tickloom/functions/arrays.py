"""Columns over arrays of a frame's bars: pieces, sums, lines and parabolas. Places start at 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(values: Column, place: Column) -> Column:
    return F.get(values, place.cast("int"))


def piece(values: Column, first: Column, last: Column) -> Column:
    """The values from ``first`` to ``last``, both included; empty where ``last`` comes before ``first``."""
    return F.slice(values, (F.greatest(first, F.lit(0)) + 1).cast("int"), F.greatest(last - F.greatest(first, F.lit(0)) + 1, F.lit(0)).cast("int"))


def newest(values: Column, n: int) -> Column:
    """The last ``n`` values, or all of fewer."""
    return piece(values, F.size(values) - n, F.size(values) - 1)


def span(first: Column, last: Column) -> Column:
    """first, first + 1, ..., last as doubles; empty where ``last`` comes before ``first``."""
    return F.when(last >= first, F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda x: x.cast("double"))).otherwise(F.array().cast("array<double>"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda held, x: held + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def squares_about(values: Column, middle: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda held, x: held + (x - middle) * (x - middle))


def deviation(values: Column, freedom: int = 0) -> Column:
    """Standard deviation with ``freedom`` taken from the count."""
    return let(mean(values), lambda m: F.sqrt(F.try_divide(squares_about(values, m), F.size(values) - freedom)))


def median(values: Column) -> Column:
    return let(F.array_sort(values), lambda s: (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2)


def place_of_least(values: Column) -> Column:
    """The first place of the least value."""
    return F.array_position(values, F.array_min(values)) - 1


def place_of_most(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def line(xs: Column, ys: Column) -> Column:
    """Least squares as (slope, intercept, r2), r2 within 0 and 1 and 1 for equal values; of fewer than two points (0, the last value, 0)."""
    return let(F.struct(xs.alias("xs"), ys.alias("ys")), lambda p: line_through(p["xs"], p["ys"]))


def line_through(xs: Column, ys: Column) -> Column:
    def fitted(m: Column) -> Column:
        cross = F.aggregate(F.zip_with(xs, ys, lambda x, y: (x - m["x"]) * (y - m["y"])), F.lit(0.0), lambda held, v: held + v)
        return let(
            F.struct(cross.alias("xy"), squares_about(xs, m["x"]).alias("xx"), squares_about(ys, m["y"]).alias("yy")),
            lambda s: F.struct(
                F.try_divide(s["xy"], s["xx"]).alias("slope"),
                (m["y"] - F.try_divide(s["xy"], s["xx"]) * m["x"]).alias("intercept"),
                F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(s["xy"] * s["xy"], s["xx"] * s["yy"]))), F.lit(1.0)).alias("r2"),
            ),
        )

    few = F.struct(F.lit(0.0).alias("slope"), F.coalesce(F.get(ys, F.size(ys) - 1), F.lit(0.0)).alias("intercept"), F.lit(0.0).alias("r2"))
    return F.when(F.size(xs) < 2, few).otherwise(let(F.struct(mean(xs).alias("x"), mean(ys).alias("y")), fitted))


def on(fit: Column, x: Column) -> Column:
    return fit["slope"] * x + fit["intercept"]


def parabola(xs: Column, ys: Column) -> Column:
    """Least squares a x^2 + b x + c as (a, b, c, r2), from sums about the middle; null where the points decide none."""
    return let(F.struct(xs.alias("xs"), ys.alias("ys")), lambda p: parabola_along(p["xs"], p["ys"]))


def parabola_along(xs: Column, ys: Column) -> Column:
    def moments(m: Column) -> Column:
        def power(k: int) -> Column:
            return F.aggregate(xs, F.lit(0.0), lambda held, x: held + F.pow(x - m["x"], F.lit(float(k))))

        def cross(k: int) -> Column:
            return F.aggregate(F.zip_with(xs, ys, lambda x, y: F.pow(x - m["x"], F.lit(float(k))) * (y - m["y"])), F.lit(0.0), lambda held, v: held + v)

        sums = {f"s{k}": power(k) for k in (2, 3, 4)} | {f"t{k}": cross(k) for k in (1, 2)} | {"yy": squares_about(ys, m["y"])}
        return let(F.struct(*[v.alias(k) for k, v in sums.items()]), lambda s: coefficients(m, s))

    def coefficients(m: Column, s: Column) -> Column:
        free = s["s4"] - F.try_divide(s["s3"] * s["s3"], s["s2"]) - F.try_divide(s["s2"] * s["s2"], F.size(xs).cast("double"))
        a = F.try_divide(s["t2"] - F.try_divide(s["s3"] * s["t1"], s["s2"]), F.when(F.abs(free) > TINY, free))
        return let(a, lambda a: let(F.try_divide(s["t1"] - a * s["s3"], s["s2"]), lambda b: shifted(m, s, a, b)))

    def shifted(m: Column, s: Column, a: Column, b: Column) -> Column:
        c = m["y"] - a * F.try_divide(s["s2"], F.size(xs).cast("double"))
        explained = a * s["t2"] + b * s["t1"]
        return F.struct(
            a.alias("a"),
            (b - 2 * a * m["x"]).alias("b"),
            (c - b * m["x"] + a * m["x"] * m["x"]).alias("c"),
            F.coalesce(F.try_divide(explained, s["yy"]), F.lit(0.0)).alias("r2"),
        )

    return F.when(F.size(xs) > 2, let(F.struct(mean(xs).alias("x"), mean(ys).alias("y")), moments))
