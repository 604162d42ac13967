"""Window helpers. All take the key columns, so they run for all instruments at once."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "symbol", "ts"


def ordered() -> WindowSpec:
    """The one window that all operators share: one exchange and one sort for all of them."""
    return Window.partitionBy(KEY).orderBy(TIME)


def trailing(n: int) -> WindowSpec:
    return ordered().rowsBetween(-(n - 1), 0)


def gated(value: Column, of: Column, n: int, least: int | None = None) -> Column:
    """``value`` over the trailing n rows, null until ``least`` (default: n) of them have ``of``."""
    return F.when(F.count(of).over(trailing(n)) >= (n if least is None else least), value)


def sma(x: Column, n: int, least: int | None = None) -> Column:
    return gated(F.avg(x).over(trailing(n)), x, n, least)


def rolling_quantile(x: Column, q: float, n: int, least: int | None = None) -> Column:
    return gated(F.percentile(x, q).over(trailing(n)), x, n, least)


def true_range() -> Column:
    before = F.lag("close").over(ordered())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def simple_return(x: str = "close") -> Column:
    return F.try_divide(F.col(x), F.lag(x).over(ordered())) - 1


def run_id(changes: Column) -> Column:
    """A number for each run of rows between changes."""
    return F.sum(F.when(changes, 1).otherwise(0)).over(ordered())
