"""Quantiles of trailing rows, several at once.

``F.percentile`` over a sliding frame counts the frame's values in a map and sorts
them anew for every row and quantile; here a frame is a row of a numpy matrix, and
quantiles of one frame share its sort. Histories come in blocks of rows with the rows
before them that their frames reach, so no array grows with a history.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import KEY, ordered

ROWS = 1 << 14


class Ask(NamedTuple):
    """The ``share`` quantile of column ``of`` over ``n`` rows up to ``back`` rows ago, null until ``least`` of them have a value."""

    of: str
    share: float
    n: int
    least: int
    back: int = 0


def sorted_frames(values: np.ndarray, place: np.ndarray, n: int, back: int):
    """(rows, their sorted frames) in turn; what isn't in a row's frame stands last, as NaN."""
    padded = np.concatenate([np.full(n - 1 + back, np.nan), values])
    frames = np.lib.stride_tricks.sliding_window_view(padded, n)
    for first in range(0, len(values), ROWS):
        rows = slice(first, min(first + ROWS, len(values)))
        own = frames[rows].copy()
        own[np.arange(n) < (n - 1 + back - place[rows])[:, None]] = np.nan
        own.sort(axis=1)
        yield rows, own


def quantiles(lists: Mapping[str, pa.Array], asks: Mapping[str, Ask]) -> pa.Array:
    """Per list and row a struct with the value of each of ``asks``: like ``F.percentile``, linear between the two nearest values that aren't null."""
    sizes = next(iter(lists.values())).value_lengths().to_numpy(zero_copy_only=False).astype(int)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    row = np.arange(len(place))
    first = row - place
    out = {name: np.full(len(place), np.nan) for name in asks}
    known = {}
    for of, n, back in dict.fromkeys((a.of, a.n, a.back) for a in asks.values()):
        flat = lists[of].flatten()
        held = ~flat.is_null().to_numpy(zero_copy_only=False)
        values = np.where(held, flat.fill_null(0.0).to_numpy(zero_copy_only=False), np.nan)
        so_far = np.concatenate([[0], np.cumsum(held)])
        end = np.maximum(row - back + 1, first)  # the frame of a row ends before it
        count = so_far[end] - so_far[np.clip(row - back - n + 1, first, end)]
        same = {name: a for name, a in asks.items() if (a.of, a.n, a.back) == (of, n, back)}
        for rows, own in sorted_frames(values, place, n, back):
            for name, ask in same.items():
                at = np.maximum(count[rows] - 1, 0) * ask.share
                low, high = np.floor(at), np.ceil(at)
                a, b = (np.take_along_axis(own, x.astype(int)[:, None], axis=1)[:, 0] for x in (low, high))
                with np.errstate(invalid="ignore"):
                    out[name][rows] = np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b)
        known |= {name: count >= max(a.least, 1) for name, a in same.items()}
    fields = [pa.array(out[name], mask=~known[name]) for name in asks]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32")), pa.StructArray.from_arrays(fields, list(asks)))


def with_quantiles(rows: DataFrame, asks: Mapping[str, Ask], block: int = 1024) -> DataFrame:
    """``rows`` with a column for each of ``asks``, in the order of ``rolling.ordered``."""
    reach = max(a.n - 1 + a.back for a in asks.values())
    block = max(block, reach)
    names, of = rows.columns, list(dict.fromkeys(a.of for a in asks.values()))
    number, own = F.col("number"), F.floor(F.col("number") / block)
    blocks = F.when(number % block >= block - reach, F.array(own, own + 1)).otherwise(F.array(own))  # a block's last rows stand before the next one's
    each = rows.withColumn("number", F.row_number().over(ordered()) - 1).withColumn("block", F.explode(blocks))
    held = each.groupBy(KEY, "block").agg(F.sort_array(F.collect_list(F.struct("number", *[n for n in names if n != KEY]))).alias("rows"))

    def told(*lists: pa.Array) -> pa.Array:
        return quantiles(dict(zip(of, lists)), asks)

    kind = f"array<struct<{','.join(f'{n}:double' for n in asks)}>>"
    held = held.withColumn("found", F.arrow_udf(told, kind)(*[F.col(f"rows.{c}").cast("array<double>") for c in of]))
    found = held.select(KEY, "block", F.explode(F.arrays_zip("rows", "found")).alias("x")).where(F.floor(F.col("x.rows.number") / block) == F.col("block"))
    return found.select(*[F.col(n) if n == KEY else F.col(f"x.rows.{n}").alias(n) for n in names], *[F.col(f"x.found.{n}").alias(n) for n in asks])


#: The outer quartiles of the 120 returns before each one.
RETURNS = {"low_return": Ask("ret", 0.25, 120, 30, 1), "high_return": Ask("ret", 0.75, 120, 30, 1)}


def trend_state(ret: Column) -> Column:
    """uptrend, downtrend or neutral: a return beyond the quartiles of RETURNS."""
    up, down = (ret > 0) & (ret >= F.col("high_return")), (ret < 0) & (ret <= F.col("low_return"))
    return F.when(up, "uptrend").when(down, "downtrend").otherwise("neutral")
