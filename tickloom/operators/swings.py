"""Frames of a symbol's newest bars, and their swings: peaks and troughs that stand out and stand apart.

A frame is one row: (symbol, end_idx, length) with its bars as arrays of at most
``MOST`` entries, so all that is asked of it is an expression of that row, but for
swings: these come from numpy over many frames at once. By default each symbol has
the frames that end at its last bar; with ``step`` also those that end at every
step-th bar, for looking back over a whole history.

Defined results: equal neighbours are one place, their middle (rounded down); the
first and the last bar are no swing; a flat series has none. Of swings nearer than
the distance the higher one stays, of equal ones the later; one that had to go
stands in nobody's way. Prominence is the height above the higher of the two
lowest bars up to the next higher bar (or the edge) on either side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import at, deviation, mean, newest, piece
from .bars import with_index

LENGTHS, LEAST, MOST = (30, 45, 60, 80, 100), 30, 120
FIELDS = ("open", "high", "low", "close", "volume")


def frames(bars: DataFrame, lengths: Sequence[int] = LENGTHS, most: int = MOST, step: int | None = None) -> DataFrame:
    """symbol, end_idx, length, start_idx and the arrays of FIELDS; lengths beyond the history are left out, all of it (at most ``most``) is one."""
    rows = with_index(bars).where("symbol is not null").withColumn("last_idx", F.max("bar_idx").over(Window.partitionBy("symbol")))
    rows = rows.where("last_idx - bar_idx < %d" % most if step is None else "true")
    ends = F.array("last_idx")
    if step is not None:
        first = F.ceil(F.col("bar_idx") / step).cast("int") * step
        on_grid = F.filter(F.sequence(first, F.col("bar_idx") + most + step, F.lit(step)), lambda e: (e < F.col("bar_idx") + most) & (e <= F.col("last_idx")))
        ends = F.array_distinct(F.concat(on_grid, F.when(F.col("last_idx") < F.col("bar_idx") + most, ends).otherwise(F.array().cast("array<int>"))))
    each = rows.select("symbol", F.explode(ends).alias("end_idx"), F.struct("bar_idx", *[F.col(f).cast("double").alias(f) for f in FIELDS]).alias("bar"))
    held = each.groupBy("symbol", "end_idx").agg(F.array_sort(F.collect_list("bar")).alias("bars"))  # ``most`` bars at most
    wanted = F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(n) for n in lengths]), F.array(F.least(F.size("bars"), F.lit(most))))))
    sized = held.withColumn("length", F.explode(F.filter(wanted, lambda n: (n <= F.size("bars")) & (n >= LEAST))))
    cut = sized.withColumn("own", F.slice("bars", F.size("bars") - F.col("length") + 1, F.col("length")))
    return cut.select("symbol", "end_idx", "length", (F.col("end_idx") - F.col("length") + 1).alias("start_idx"), *[F.col(f"own.{f}").alias(f) for f in FIELDS])


def tops(values: np.ndarray) -> np.ndarray:
    """Where a row is higher than at both neighbours; of equal neighbours the middle, rounded down."""
    n = values.shape[1]
    found = np.zeros(values.shape, bool)
    own, after = values[:, 1:-1], values[:, 2:]
    rises = own > values[:, :-2]
    found[:, 1:-1] = rises & (after < own)
    row, place = np.nonzero(rises & ~((after < own) | (after > own)))  # the next value is equal (or missing)
    place += 1
    whole, own = values[row], values[row, place][:, None]
    ends = ((whole < own) | (whole > own)) & (np.arange(n) > place[:, None])
    end = ends.argmax(axis=1)
    falls = ends.any(axis=1) & (whole[np.arange(len(row)), end] < own[:, 0])
    found[row[falls], (place + end - 1)[falls] // 2] = True
    return found & ~np.isnan(values)


def apart(values: np.ndarray, places: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The places that stay when the highest first takes ``distance`` to either side."""
    n = values.shape[1]
    kept, left = np.zeros(places.shape, bool), places.copy()
    while len(row := np.nonzero(left.any(axis=1))[0]):
        place = n - 1 - np.where(left[row], values[row], -np.inf)[:, ::-1].argmax(axis=1)
        kept[row, place] = True
        left[row] &= np.abs(np.arange(n) - place[:, None]) >= distance[row, None]
        left[row, place] = False
    return kept


def prominence(values: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    n, whole, own, at_ = values.shape[1], values[row], values[row, place], place[:, None]
    k, higher = np.arange(n), whole > own[:, None]
    left = np.where(higher & (k < at_), k, -1).max(axis=1)[:, None]
    right = np.where(higher & (k > at_), k, n).min(axis=1)[:, None]
    known = np.where(np.isnan(whole), np.inf, whole)
    lowest = [np.where(within, known, np.inf).min(axis=1) for within in ((k > left) & (k <= at_), (k >= at_) & (k < right))]
    return np.where(own == np.inf, np.inf, own - np.maximum(*lowest))


def flat_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values in turn, where each list starts and its size.

    A missing value is NaN there, which is higher and lower than nothing; Spark's NaN,
    which is higher than all numbers, is infinite.
    """
    flat = values.flatten()
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    flat = np.nan_to_num(flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float), nan=np.inf, posinf=np.inf, neginf=-np.inf)
    flat[missing] = np.nan
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    return flat, np.cumsum(sizes) - sizes, sizes


def matrices(starts: np.ndarray, sizes: np.ndarray, least: int):
    """(rows, places of their values) of up to 2,000 lists of one size, ``least`` or more, in turn."""
    for n in np.unique(sizes[sizes >= least]):
        same = np.nonzero(sizes == n)[0]
        for of in np.array_split(same, len(same) // 2000 + 1):
            yield of, starts[of][:, None] + np.arange(n)


def swings_of(values: pa.Array, distance: pa.Array, least: pa.Array) -> pa.Array:
    """Per row its swings as (place, prominence): tops, apart from each other, of at least that prominence.

    Rows of equal length are one matrix.
    """
    flat, starts, sizes = flat_of(values)
    distance, least = (np.asarray(x.cast(pa.float64()).to_numpy(zero_copy_only=False)) for x in (distance, least))
    rows, places, heights = [], [], []
    for of, at_ in matrices(starts, sizes, 3):
        own = flat[at_]
        row, place = np.nonzero(apart(own, tops(own), distance[of]))
        height = prominence(own, row, place)
        high = height >= np.where(np.isnan(least[of]), np.inf, least[of])[row]
        rows.append(of[row[high]])
        places.append(place[high])
        heights.append(height[high])
    rows, places, heights = (np.concatenate([np.zeros(0, kind), *x]).astype(kind) for x, kind in ((rows, int), (places, "int32"), (heights, float)))
    order = np.lexsort((places, rows))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(sizes)))]).astype("int32")
    pairs = pa.StructArray.from_arrays([pa.array(places[order]), pa.array(heights[order])], ["place", "prominence"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def found(values: Column, distance: Column, least: Column) -> Column:
    return F.arrow_udf(swings_of, "array<struct<place:int,prominence:double>>")(values, distance, least)


def standing_out(values: Column, distance: Column, least: Column) -> Column:
    """Places of swings: tops, apart from each other, of at least that prominence."""
    return found(values, distance, least)["place"]


def with_swings(rows: DataFrame) -> DataFrame:
    """``frames`` with atr, distance, prominence, peaks and troughs (places in the frame)."""
    before = F.concat(F.slice("close", 1, 1), piece(F.col("close"), F.lit(0), F.size("close") - 2))
    bar = F.arrays_zip(newest(F.col("high"), 14).alias("h"), newest(F.col("low"), 14).alias("l"), newest(before, 14).alias("c"))
    ranges = F.transform(bar, lambda b: F.greatest(b["h"] - b["l"], F.abs(b["h"] - b["c"]), F.abs(b["l"] - b["c"])))
    atr = F.greatest(mean(ranges), at(F.col("close"), F.col("length") - 1) * 0.002)
    rows = rows.withColumn("atr", atr).withColumns({
        "distance": F.greatest(F.lit(3), F.floor(F.col("length") / 14).cast("int")),
        "prominence": F.greatest(F.col("atr") * 0.8, deviation(F.col("close"), 1) * 0.12),
        "depths": F.transform("low", lambda x: -x),
    })
    sides = {f"{name}_found": found(F.col(values), F.col("distance"), F.col("prominence")) for name, values in (("peaks", "high"), ("troughs", "depths"))}
    return rows.withColumns(sides).withColumns({"peaks": F.col("peaks_found.place"), "troughs": F.col("troughs_found.place")}).drop("depths")


def swings(bars: DataFrame, **options) -> DataFrame:
    """symbol, end_idx, length, kind, bar_idx, price, prominence per swing of ``frames``."""
    rows = with_swings(frames(bars, **options))

    def side(kind: str, found: str, price: str) -> Column:
        return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), (F.col("start_idx") + s["place"]).alias("bar_idx"), at(F.col(price), s["place"]).alias("price"), s["prominence"].alias("prominence")))

    both = F.concat(side("peak", "peaks_found", "high"), side("trough", "troughs_found", "low"))
    return rows.select("symbol", "end_idx", "length", F.explode(both).alias("s")).select("symbol", "end_idx", "length", "s.*")
