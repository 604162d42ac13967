"""Recurrences in blocks of time equal those over whole histories, whatever the blocks."""

import random
from datetime import date, timedelta

import pytest

from tickloom.operators import indicators

DAYS = 120


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = random.Random(4), []
    for symbol, gap in (("dense", 1), ("sparse", 40), ("flat", 3), ("one", 0)):
        day, close = date(2010, 12, 31), 100.0  # the first year of each has one bar
        for _ in range(DAYS if gap else 1):
            close = close if symbol == "flat" else close * (1 + rng.uniform(-0.03, 0.03))
            rows.append((symbol, day, close, close * 1.01 if symbol != "flat" else close, close * 0.98 if symbol != "flat" else close, close))
            day += timedelta(days=rng.randint(1, 2 * gap or 1))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double").cache()


def smooth(xs, alpha):
    out = []
    for x in xs:
        out.append(x if not out else out[-1] + alpha * (x - out[-1]))
    return out


def plain(kind, rows):
    close = [r["close"] for r in rows]
    if kind == "ewm":
        return [(x,) for x in smooth(close, 2 / 13)]
    if kind == "macd":
        dif = [a - b for a, b in zip(smooth(close, 2 / 13), smooth(close, 2 / 27), strict=True)]
        return [(d, e, 2 * (d - e)) for d, e in zip(dif, smooth(dif, 0.2), strict=True)]
    if kind == "rsi":
        change = [b - a for a, b in zip(close, close[1:], strict=False)]
        gain, loss = smooth([max(c, 0) for c in change], 1 / 14), smooth([max(-c, 0) for c in change], 1 / 14)
        return [(50.0,)] + [(100 - 100 / (1 + g / w) if w else 50.0,) for g, w in zip(gain, loss, strict=True)]
    raw = []
    for i in range(len(rows)):
        window = rows[i - 8 : i + 1] if i >= 8 else []
        low, high = (min(r["low"] for r in window), max(r["high"] for r in window)) if window else (0, 0)
        raw.append((close[i] - low) / (high - low) * 100 if high != low else 50.0)
    k = smooth(raw, 1 / 3)
    return [(a, b, 3 * a - 2 * b) for a, b in zip(k, smooth(k, 1 / 3), strict=True)]


@pytest.mark.parametrize("block", ["week", "year", "century"])
@pytest.mark.parametrize("kind", ["ewm", "macd", "rsi", "kdj"])
def test_blocks_equal_whole_histories(bars, kind, block):
    got = getattr(indicators, kind)(bars, block=block).orderBy("symbol", "ts").collect()
    rows = bars.orderBy("symbol", "ts").collect()
    assert [(r["symbol"], r["ts"]) for r in got] == [(r["symbol"], r["ts"]) for r in rows]
    for symbol in ("dense", "sparse", "flat", "one"):
        want = plain(kind, [r for r in rows if r["symbol"] == symbol])
        for g, w in zip([tuple(r)[3:] for r in got if r["symbol"] == symbol], want, strict=True):
            assert g == pytest.approx(w, rel=1e-9, abs=1e-9)


def test_no_bars(bars):
    assert indicators.macd(bars.where("false")).collect() == []
