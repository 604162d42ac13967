"""Linear recurrences over histories of any length, in blocks of time.

An exponential average carries a state from bar to bar, so a history looks like one
task's work. But it is linear: what a block of bars makes of the state it gets is
what it makes of zero, plus the state through its response, a small matrix. So

1. each (symbol, block) finds its end from zero, its response, and its end when
   nothing comes before it;
2. the blocks of a symbol, one small row each, fold in order to the state at each seam;
3. each (symbol, block) runs once more, from the state at its own seam.

Blocks are spans of time, so no bar has to be numbered first; both passes over the
bars group by the same keys and share one shuffle. Rows before a block that its
windows need (the last ``reach`` bars) come from the last bars of earlier blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAR = ("high", "low", "close")


@dataclass(frozen=True)
class Recurrence:
    """``drivers`` of a block (bars in order, as many as ``reach`` before the block's own); ``states`` of drivers from a state, linear in both; ``shown`` of drivers and states."""

    reach: int
    width: int
    drivers: Callable[[pd.DataFrame], np.ndarray]
    states: Callable[[np.ndarray, np.ndarray], np.ndarray]
    shown: Callable[[np.ndarray], dict[str, np.ndarray]]
    added: str


def smoothed(x: np.ndarray, alpha: float, before: float) -> np.ndarray:
    """The exponential average after ``before``; without one (nan) it starts with the first value."""
    return pd.Series(np.concatenate([[before], x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def ends(r: Recurrence, drivers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End from zero, response, and end of a block that comes first."""
    zero, none = np.zeros(r.width), np.full(r.width, np.nan)
    still = np.zeros_like(drivers)
    response = np.column_stack([r.states(still, unit)[-1] for unit in np.eye(r.width)])
    clean = np.nan_to_num(drivers)  # only the first bars of a history can have no driver, and they come from no state
    return r.states(clean, zero)[-1], response, r.states(drivers, none)[-1]


def seams_of(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> list[np.ndarray]:
    """The state before each block."""
    state, out = np.full(width, np.nan), []
    for end, response, fresh in blocks:
        out.append(state)
        state = fresh if np.isnan(state).any() else end + response @ state
    return out


def run(bars: DataFrame, r: Recurrence, block: str = "year") -> DataFrame:
    """(symbol, ts, close, what the recurrence shows); ``block`` is a span that ``date_trunc`` knows.

    A block has to fit a task. Bars need distinct (symbol, ts) and no nulls, as
    ``bars.clean`` gives them; empty input gives no rows.
    """
    kind = bars.schema["ts"].dataType.simpleString()
    own = bars.select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in BAR], F.date_trunc(block, "ts").alias("block"))
    keys, bar = ["symbol", "block"], F.struct("ts", *BAR)

    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ts").desc()))
    last = own.withColumn("back", back).where(F.col("back") <= max(r.reach, 1))
    earlier = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-r.reach, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("ts"))
    before = (F.collect_list(bar).over(earlier) if r.reach else F.array().cast(f"array<struct<ts:{kind},high:double,low:double,close:double>>"))
    seams = last.withColumns({"before": before, "first": first}).where("first = 1").select(*keys, "before")

    def drivers(group: pd.DataFrame, seam: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        group = group.sort_values("ts", ignore_index=True)
        ahead = pd.DataFrame([{c: b[c] for c in BAR} for b in seam["before"].iloc[0]], columns=list(BAR), dtype=float)
        return group, r.drivers(pd.concat([ahead, group[list(BAR)]], ignore_index=True))[len(ahead) :]

    def summed(group: pd.DataFrame, seam: pd.DataFrame) -> pd.DataFrame:
        group, x = drivers(group, seam)
        end, response, fresh = ends(r, x)
        return pd.DataFrame({"symbol": group["symbol"][:1], "block": group["block"][:1], "before": seam["before"].iloc[:1].to_list(), "end": [end.tolist()], "response": [response.ravel().tolist()], "fresh": [fresh.tolist()]})

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        parts = [(np.asarray(e, float), np.asarray(m, float).reshape(r.width, r.width), np.asarray(f, float)) for e, m, f in zip(rows["end"], rows["response"], rows["fresh"], strict=True)]
        return rows[["symbol", "block", "before"]].assign(state=[s.tolist() for s in seams_of(parts, r.width)])

    def finished(group: pd.DataFrame, seam: pd.DataFrame) -> pd.DataFrame:
        group, x = drivers(group, seam)
        shown = r.shown(r.states(x, np.asarray(seam["state"].iloc[0], float)))
        return pd.concat([group[["symbol", "ts", "close"]], pd.DataFrame(shown)], axis=1)

    ahead = f"before array<struct<ts:{kind},high:double,low:double,close:double>>"
    grouped = own.groupBy(*keys)
    parts = grouped.cogroup(seams.groupBy(*keys)).applyInPandas(summed, f"symbol string, block timestamp, {ahead}, end array<double>, response array<double>, fresh array<double>")
    states = parts.groupBy("symbol").applyInPandas(folded, f"symbol string, block timestamp, {ahead}, state array<double>")
    return grouped.cogroup(states.groupBy(*keys)).applyInPandas(finished, f"symbol string, ts {kind}, close double, {r.added}")


def ewm(span: int) -> Recurrence:
    return Recurrence(0, 1, lambda g: g[["close"]].to_numpy(), lambda x, s: smoothed(x[:, 0], 2 / (span + 1), s[0])[:, None], lambda y: {"ema": y[:, 0]}, "ema double")


def macd(fast: int, slow: int, signal: int) -> Recurrence:
    def states(x: np.ndarray, s: np.ndarray) -> np.ndarray:
        near, far = smoothed(x[:, 0], 2 / (fast + 1), s[0]), smoothed(x[:, 0], 2 / (slow + 1), s[1])
        return np.column_stack([near, far, smoothed(near - far, 2 / (signal + 1), s[2])])

    def shown(y: np.ndarray) -> dict[str, np.ndarray]:
        dif = y[:, 0] - y[:, 1]
        return {"dif": dif, "dea": y[:, 2], "hist": 2 * (dif - y[:, 2])}

    return Recurrence(0, 3, lambda g: g[["close"]].to_numpy(), states, shown, "dif double, dea double, hist double")


def rsi(n: int) -> Recurrence:
    """50 where there is no average loss, as for the first bar."""

    def drivers(g: pd.DataFrame) -> np.ndarray:
        change = g["close"].diff()
        return np.column_stack([change.clip(lower=0), -change.clip(upper=0)])

    def shown(y: np.ndarray) -> dict[str, np.ndarray]:
        gain, loss = pd.Series(y[:, 0]), pd.Series(y[:, 1])
        return {"rsi": (100 - 100 / (1 + gain / loss.where(loss != 0))).fillna(50.0).to_numpy()}

    return Recurrence(1, 2, drivers, lambda x, s: np.column_stack([smoothed(x[:, i], 1 / n, s[i]) for i in (0, 1)]), shown, "rsi double")


def kdj(n: int, k: int, d: int) -> Recurrence:
    """The raw value is 50 while the window isn't full and when its range is zero."""

    def drivers(g: pd.DataFrame) -> np.ndarray:
        low, high = g["low"].rolling(n).min(), g["high"].rolling(n).max()
        return ((g["close"] - low) / (high - low).where(high != low) * 100).fillna(50.0).to_numpy()[:, None]

    def states(x: np.ndarray, s: np.ndarray) -> np.ndarray:
        line = smoothed(x[:, 0], 1 / k, s[0])
        return np.column_stack([line, smoothed(line, 1 / d, s[1])])

    return Recurrence(n - 1, 2, drivers, states, lambda y: {"k": y[:, 0], "d": y[:, 1], "j": 3 * y[:, 0] - 2 * y[:, 1]}, "k double, d double, j double")
