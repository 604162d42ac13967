"""Kept trends, chart sets, safety lines and centre averages against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tickloom.operators import averages, choice, events, judgment


def plain_trends(rows):
    stay = []
    for side in {r["direction"] for r in rows}:
        held = []
        for r in sorted((dict(r) for r in rows if r["direction"] == side), key=lambda r: (-r["confidence"], events.TREND_ORDER.index(r["pattern"]), r["start_idx"])):
            near = [h for h in held if r["start_idx"] - 2 <= h["end_idx"] and h["start_idx"] - 2 <= r["end_idx"]]
            if len(held) == 3:
                break
            if near:
                near[0]["start_idx"], near[0]["end_idx"] = min(near[0]["start_idx"], r["start_idx"]), max(near[0]["end_idx"], r["end_idx"])
            else:
                held.append(r)
        stay += held
    out = []
    for r in sorted(stay, key=lambda r: (r["start_idx"], -r["confidence"], events.TREND_ORDER.index(r["pattern"]))):
        if len([o for o in out if o["end_idx"] >= r["start_idx"]]) < 3:
            out.append(r)
    return sorted((r["pattern"], r["direction"], r["start_idx"], r["end_idx"], r["confidence"]) for r in out)


def test_kept_trends(spark):
    rng, rows = random.Random(3), []
    for s in range(40):
        for _ in range(rng.randint(0, 14)):
            start = rng.randint(0, 90)
            rows.append((f"s{s}", rng.choice(events.TREND_ORDER), rng.choice(["bullish", "bearish"]), start, start + rng.randint(3, 40), rng.choice([0.6, 0.7, 0.8])))
    names = ["symbol", "pattern", "direction", "start_idx", "end_idx", "confidence"]
    got = events.kept_trends(spark.createDataFrame(rows, "symbol string, pattern string, direction string, start_idx int, end_idx int, confidence double")).collect()
    want = {s: plain_trends([dict(zip(names, r, strict=True)) for r in rows if r[0] == s]) for s in {r[0] for r in rows}}
    assert {s: sorted(tuple(r[1:]) for r in got if r[0] == s) for s in want} == want
    assert any(len(w) == 3 for w in want.values()) and any(len(w) > 3 for w in want.values())


def plain_chart_set(rows):
    held = []
    for r in sorted(rows, key=lambda r: (-judgment.FAMILY_RANK.get(r["family"], 0), r["state"] != "confirmed", -r["confidence"], r["id"])):
        if r["confidence"] < ([0.65, 0.85, 0.93] + [min(0.995, 0.93 + 0.02 * k) for k in range(1, 50)])[len(held)]:
            continue
        for h in held:
            both = {r["family"], h["family"]}
            bars = [set(range(x["start"], x["end"] + 1)) for x in (r, h)]
            share = len(bars[0] & bars[1]) / len(range(min(r["start"], h["start"]), max(r["end"], h["end"]) + 1))
            kin = both in judgment.RELATED
            if kin and share > 0.40 or share > 0.65 and (len(both) == 1 or r["direction"] != h["direction"]):
                break
            if len(both) == 2 and share > 0.35 and all(f in judgment.FAMILY_RANK for f in both) or r["pattern"] == h["pattern"] and abs(r["end"] - h["end"]) < 20:
                break
        else:
            held.append(r)
    return [(r["id"], k) for k, r in enumerate(held, 1)]


def test_chart_set(spark):
    rng, rows = random.Random(8), []
    names = ["asset", "id", "pattern", "kind", "direction", "state", "confidence", "start", "end", "family"]
    for n in range(900):
        start = rng.randint(0, 400)
        rows.append((n % 15, n, rng.choice("pqrstu"), rng.choice(["chart", "chart", "candlestick"]), rng.choice(["bullish", "bearish"]), rng.choice(["confirmed", "detected"]), rng.choice([0.5, 0.65, 0.86, 0.94, 0.96, 0.98, 1.0]), start, start + rng.randint(0, 60), rng.choice([*judgment.FAMILY_RANK, "other"])))
    got = choice.chart_set(spark.createDataFrame(rows, "asset long, id long, pattern string, kind string, direction string, state string, confidence double, start long, end long, family string")).collect()
    for asset in range(15):
        charts = [dict(zip(names, r, strict=True)) for r in rows if r[0] == asset and r[3] == "chart"]
        assert sorted((r["id"], r["rank"]) for r in got if r["asset"] == asset) == sorted(plain_chart_set(charts))
    assert max(r["rank"] for r in got) > 3


SIGNAL = "asset long, id long, pattern string, kind string, direction string, state string, confidence double, start long, end long, family string"


def test_chart_set_makes_no_pairs(spark):
    """A crowd of signals of one asset on one place passes by those that stay; before, each met each."""
    rows = [(1, n, "pqrs"[n % 4], "chart", "bullish", "confirmed", 1.0, n % 3, 30 + n % 3, "triangle") for n in range(20_000)]
    got = choice.chart_set(spark.createDataFrame(rows, SIGNAL))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["id"], r["rank"]) for r in got.collect()] == [(0, 1)]
    assert [judgment.threshold_after(k) for k in range(9)] == [r[0] for r in spark.range(9).orderBy("id").select(judgment.rolling_threshold(F.col("id"))).collect()]


def test_chart_set_of_odd_signals(spark):
    odd = [
        (1, 1, "p", "chart", "bullish", "confirmed", 1.0, None, 30, "triangle"), (1, 2, "p", "chart", "bullish", "confirmed", 1.0, 0, 30, "triangle"),
        (1, 3, None, "chart", None, "confirmed", 1.0, 200, 230, None), (1, 4, None, "chart", None, None, 1.0, 201, 231, None), (1, 5, "q", "chart", "bullish", "confirmed", None, 400, 430, "box"),
        (None, 6, "p", "chart", "bullish", "confirmed", float("nan"), 0, 30, "triangle"), (2, 7, "p", "chart", "bullish", "confirmed", 1.0, 90, 30, "triangle"), (2, 8, "p", "chart", "bullish", "confirmed", 1.0, 90, 30, "triangle"),
    ]
    got = choice.chart_set(spark.createDataFrame(odd, SIGNAL)).collect()
    assert sorted((r["id"], r["rank"]) for r in got) == [(1, 1), (2, 2), (3, 3), (6, 1), (7, 1), (8, 2)]


def walk(seed, n, drift=0.0004):
    rng, close = random.Random(seed), [100.0]
    while len(close) < n:
        close.append(round(close[-1] * (1 + drift + rng.uniform(-0.02, 0.02)), 1))
    return close


def as_bars(spark, series):
    rows = [(name, i, c, c, c) for name, close in series.items() for i, c in enumerate(close)]
    days = spark.createDataFrame(rows, "symbol string, i int, high double, low double, close double")
    return days.selectExpr("symbol", "date_add(date '2001-01-01', i) as ts", "close as open", "high", "low", "close", "1.0 as volume")


def plain_safety(close):
    found = []
    for n in sorted({*range(200, min(600, len(close) - 20) + 1, 5), min(600, len(close) - 20)}):
        line = [sum(close[i - n + 1 : i + 1]) / n for i in range(n - 1, len(close))]
        low = [i for i in range(n - 1, len(close) - 10) if close[i] <= line[i - n + 1] + 1e-9][-120:]
        again = [next((j - i for j in range(i + 1, min(i + 505, len(close))) if close[j] >= close[i]), None) for i in low]
        hit = [w for w in again if w]
        share = len(hit) / len(low) if low else 0.0
        wild = statistics.pstdev(b / a - 1 for a, b in zip(line, line[1:], strict=False)) * 252**0.5
        if line[-1] / line[-min(60, len(line))] - 1 > -0.12 and share >= 0.58:
            found.append((n, line[-1], share, wild, statistics.median(hit)))
    if not found:
        return {}
    cheap, calm = max(found, key=lambda f: f[1]), max(found, key=lambda f: (f[2] - 2 * f[3], f[0]))
    if calm[1] > cheap[1]:
        cheap, calm = calm, cheap
    return {"cheap": cheap, "carefree": calm}


def test_safety_lines(spark):
    series = {"a": walk(1, 700), "b": walk(2, 420), "short": walk(3, 219), "just": walk(6, 220, 0.002), "falls": walk(4, 500, -0.01)}
    got = averages.safety_lines(as_bars(spark, series)).collect()
    for name, close in series.items():
        want = plain_safety(close) if len(close) >= 220 else {}
        own = {r["line"]: r for r in got if r["symbol"] == name}
        assert own.keys() == want.keys()
        for line, (n, value, share, _, days) in want.items():
            assert own[line]["period"] == n and own[line]["median_days"] == days
            assert own[line]["value"] == pytest.approx(value) and own[line]["recovery"] == pytest.approx(share)
    assert {r["symbol"] for r in got} >= {"a", "b"}


def test_waits():
    rng = random.Random(1)
    close = [rng.randint(1, 20) for _ in range(300)]
    assert list(averages.waits(close)) == [next((j - i for j in range(i + 1, 300) if close[j] >= close[i]), 0) for i in range(300)]


def test_center_average(spark):
    series = {"a": walk(11, 300), "b": walk(12, 90)}
    got = {r["symbol"]: r for r in averages.center_average(as_bars(spark, series), 3).collect()}
    for name, close in series.items():
        best, m = None, len(close)
        for n in range(max(20, m // 8), min(m - 10, m // 2) + 1):
            off = [close[i] - sum(close[i - n + 1 : i + 1]) / n for i in range(n - 1, m)]
            if len(off) < max(30, m // 5):
                continue
            turns = sum((a > 0) != (b > 0) or (a == 0) != (b == 0) for a, b in zip(off, off[1:], strict=False))
            key = (abs(sum(o > 0 for o in off) / len(off) - 0.5), -turns, n)
            best = min(best or key, key)
        assert (got[name]["period"], got[name]["crossings"], got[name]["unit"]) == (best[2], -best[1], "day")
