"""Swings and chart structures against plain loops, on walks made from line items and on drawn cases."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.plain_charts import Frame, frames, rounded, swings
from tickloom.functions.arrays import line, parabola
from tickloom.operators import charts
from tickloom.operators import swings as S
from tickloom.operators.bars import build
from tickloom.sources.bars import supplier_walk

SCHEMA = "symbol string, ts int, open double, high double, low double, close double, volume double"
FIELDS = ("pattern", "direction", "confidence", "start", "end", "confirmed", "false_break", "level", "height")


def drawn(points, wiggle=0.0, volume=1000.0):
    """Bars along straight lines between (place, close) points; ``wiggle`` is the size of the shadows."""
    out, last = [], points[0][1]
    for (x1, y1), (x2, y2) in zip(points, points[1:], strict=False):
        for x in range(x1, x2):
            c = y1 + (y2 - y1) * (x - x1) / (x2 - x1)
            out.append({"open": last, "high": max(last, c) + wiggle, "low": min(last, c) - wiggle, "close": c, "volume": volume})
            last = c
    return out


def walk(seed, n, flat=False):
    rng = random.Random(seed)
    out, c = [], 100.0
    for _ in range(n):
        o = c
        c = c if flat else max(1.0, c * math.exp(rng.gauss(0, 0.02)))
        step = round(c) if seed % 3 == 0 and not flat else c  # equal neighbours
        out.append({"open": o, "high": max(o, step) + rng.choice([0, 1]), "low": max(min(o, step) - rng.choice([0, 1]), 0.5), "close": step, "volume": rng.randint(0, 9) * 100.0})
        c = step
    return out


CASES = {
    "double_top": drawn([(0, 80), (20, 100), (28, 90), (36, 100), (45, 86), (46, 86)], 0.3),
    "double_top, too far apart in height": drawn([(0, 80), (20, 100), (28, 90), (36, 107), (45, 86), (46, 86)], 0.3),
    "no trend before": drawn([(0, 98), (20, 100), (28, 90), (36, 100), (45, 86), (46, 86)], 0.3),
    "heads": drawn([(0, 70), (15, 92), (22, 84), (30, 102), (38, 84), (45, 92), (55, 78), (60, 78)], 0.3),
    "low head": drawn([(0, 70), (15, 92), (22, 84), (30, 94), (38, 84), (45, 92), (55, 78), (60, 78)], 0.3),
    "cup": [b for b in drawn([(0, 90), (12, 100), (20, 86), (34, 80), (46, 88), (56, 100), (63, 96), (68, 98), (69, 98)], 0.3)],
    "deep handle": [b for b in drawn([(0, 90), (12, 100), (20, 86), (34, 80), (46, 88), (56, 100), (63, 84), (68, 86), (69, 86)], 0.3)],
    "v": drawn([(0, 120), (25, 80), (50, 120), (51, 120)], 0.2),
    "two bottoms": drawn([(0, 120), (20, 80), (28, 95), (36, 80.5), (55, 120), (56, 120)], 0.2),
    "rectangle": drawn([(0, 100), (6, 108), (12, 100), (18, 108), (24, 100), (30, 108), (36, 100), (42, 108), (48, 104), (49, 104)], 0.5),
    "triangle": drawn([(0, 85), (6, 110), (12, 88), (20, 110), (28, 94), (36, 110), (44, 100), (50, 109), (55, 106), (56, 106)], 0.5),
    "flat": walk(3, 60, flat=True),
    "sine": [{"open": 100 + 0.045 * x + 6 * math.sin(x / 19) + 2.2 * math.sin(x / 6) - 0.45 * math.cos(x / 8), "close": 100 + 0.045 * x + 6 * math.sin(x / 19) + 2.2 * math.sin(x / 6), "volume": 1e6 + x % 23 * 17000.0} for x in range(720)],
    "short": walk(5, 29),
    "thirty": walk(6, 30),
} | {f"walk {i}": walk(i, 60 + 11 * i) for i in range(12)}
for bar in CASES["sine"]:
    bar.update(high=max(bar["open"], bar["close"]) + 1, low=min(bar["open"], bar["close"]) - 1)


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(name, i, *(float(b[k]) for k in ("open", "high", "low", "close", "volume"))) for name, bars in CASES.items() for i, b in enumerate(bars)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def expected(series, daily, step=None):
    out = []
    for name, bars in series.items():
        ends = {len(bars) - 1} | (set(range(0, len(bars), step)) if step else set())
        for end in ends:
            for start, own in frames(bars[: end + 1]):
                out += [(name, end, len(own), *found) for found in Frame(own, start, daily).all()]
    return sorted(map(rounded, out), key=repr)


def got(df):
    return sorted((rounded(r) for r in df.select("symbol", "end_idx", "length", *FIELDS).collect()), key=repr)


@pytest.fixture(scope="module")
def found(cases):
    return charts.detect(cases).cache()


def test_structures_of_drawn_cases(found):
    want = expected(CASES, True)
    assert got(found) == want
    by = defaultdict(set)
    for r in want:
        by[r[0]].add(r[3])
    assert "double_top" in by["double_top"] and "double_top" not in by["double_top, too far apart in height"] and "double_top" not in by["no trend before"]
    assert any("head_and_shoulders_top" in p for p in by["heads"]) and not any("head_and_shoulders" in p for p in by["low head"])
    assert "cup_with_handle" in by["cup"] and "cup_with_handle" not in by["deep handle"]
    assert "v_bottom" in by["v"] and not any(r[0] == "two bottoms" and r[2] == 56 and r[3] == "v_bottom" for r in want)
    assert "rectangle" in by["rectangle"] and "ascending_triangle" in by["triangle"]
    assert not by["flat"] and not by["short"]


def test_structures_of_walks_at_many_ends(spark):
    bars = build(supplier_walk(spark, "/root/testdata/sf0.001"))
    series = defaultdict(list)
    for r in sorted(bars.collect(), key=lambda r: (r["symbol"], r["ts"])):
        series[r["symbol"]].append(r)
    want = expected(series, False, 60)
    assert got(charts.detect(bars, daily=False, step=60)) == want
    assert len(Counter(r[3] for r in want)) >= 15


def test_swings(cases):
    found = defaultdict(list)
    for r in S.swings(cases).collect():
        found[(r["symbol"], r["length"], r["kind"])].append((r["bar_idx"], r["price"]))
    want = defaultdict(list)
    for name, bars in CASES.items():
        for start, own in frames(bars):
            f = Frame(own, start, True)
            for kind, places, values in (("peak", f.peaks, f.h), ("trough", f.troughs, f.l)):
                if places:
                    want[(name, len(own), kind)] = [(start + p, values[p]) for p in places]
    assert {k: sorted(v) for k, v in found.items()} == dict(want)


def test_equal_tops_and_distance(spark):
    values = [1, 5, 5, 1, 5, 1, 2, 1, 7, 7, 7, 1, 1, 6, 1]
    assert swings(values, 1, 0) == [1, 4, 6, 9, 13] and swings(values, 4, 0) == [4, 9, 13] and swings(values, 1, 3) == [1, 4, 9, 13]
    row = spark.createDataFrame([(list(map(float, values)),)], "v array<double>")
    for distance, least in ((1, 0), (4, 0), (1, 3), (5, 2)):
        assert row.select(S.standing_out(F.col("v"), F.lit(distance), F.lit(least))).first()[0] == swings(values, distance, least)


def test_swings_of_many_frames_at_once(spark):
    rng = random.Random(4)
    rows = [[float(rng.randint(0, 9)) for _ in range(rng.choice([0, 1, 2, 3, 7, 30, 31]))] for _ in range(300)]
    asked = [(i, v, rng.randint(1, 5), rng.randint(0, 3)) for i, v in enumerate(rows)]
    odd = [(1000, [1.0, 5.0, None, 2.0, 9.0, 3.0], 1, 0), (1001, [1.0, 5.0, None, 5.0, 1.0], 1, 0), (1002, [1.0, float("nan"), 2.0, 4.0, 1.0], 1, 0), (1003, None, 1, 0)]
    df = spark.createDataFrame(asked + odd, "i int, v array<double>, distance int, least int")
    got = {r["i"]: r["p"] for r in df.select("i", S.standing_out(F.col("v"), F.col("distance"), F.col("least")).alias("p")).collect()}
    assert {i: got[i] for i, *_ in asked} == {i: swings(v, distance, least) for i, v, distance, least in asked}
    assert [got[i] or [] for i, *_ in odd] == [[1, 4], [], [1, 3], []]


def test_swings_read_frames_once(cases):
    """Every frame is made once and its swings are one numpy function; before, both sides made all frames and every prominence was an expression."""
    plan = S.swings(cases)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and plan.count("ArrowEvalPython") == 1


def test_fits_make_their_points_once(spark):
    """The points of a fit may be long expressions; before, they were made anew for each sum."""
    rows = spark.createDataFrame([([1.0, 2.0, 4.0], [3.0, 1.0, 2.0])], "xs array<double>, ys array<double>")
    for fit in (line, parabola):
        made = rows.select(fit(F.col("xs"), F.col("ys")).alias("fit"))._jdf.queryExecution().analyzed().toString().splitlines()[0]
        assert made.count("xs#") == 1 and made.count("ys#") == 1


def test_islands_of_many_gaps(spark):
    """Walks in which nearly every bar is a gap; before, each frame met all its pairs of gaps in expressions."""
    rng, rows = random.Random(8), []
    for i in range(600):
        n, price, bars = rng.choice([1, 2, 30, 45, 61]), 100.0, []
        for _ in range(n):
            price *= math.exp(rng.gauss(0, 0.03))
            close = price if i % 3 else round(price / 4) * 4.0
            wide = rng.choice([0, 0, 0.2, 1, 3])
            bars.append({"open": close, "high": close + wide, "low": close - wide, "close": close, "volume": 1.0})
        rows.append(bars)
    asked = [(i, *([b[k] for b in bars] for k in ("high", "low", "close"))) for i, bars in enumerate(rows)]
    asked.append((600, [1.0, None, 1.0], [1.0, 2.0, 1.0], [1.0, 2.0, None]))
    df = spark.createDataFrame(asked, "i int, high array<double>, low array<double>, close array<double>").repartition(3)
    found = {r["i"]: r["isle"] for r in charts.with_islands(df).collect()}
    assert "ArrowEvalPython" in charts.with_islands(df)._jdf.queryExecution().optimizedPlan().toString() and found.pop(600) is None
    want = {}
    for i, bars in enumerate(rows):
        frame = Frame(bars, 0, False)
        frame.island(0.0)
        want[i] = [("island_reversal_" + ("top" if f["top"] else "bottom"), f["a"], f["b"]) for f in [found[i]] if f], [(s[0], s[3], s[4]) for s in frame.found]
    assert all(a == b for a, b in want.values()) and sum(bool(a) for a, _ in want.values()) > 100


def test_bars_of_walks_are_hashed(spark):
    """Ticks are numbers; before, they were structs, for which both sides of the aggregate sorted all rows."""
    plan = build(supplier_walk(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_best_of_each_family(found):
    every = found.collect()
    best = defaultdict(list)
    for r in every:
        best[(r["symbol"], r["end_idx"], r["family"])].append((not r["confirmed"], -round(r["confidence"], 9), -r["length"], r["pattern"], r["start"], r["end"]))
    chosen = {(r["symbol"], r["end_idx"], r["family"]): (not r["confirmed"], -round(r["confidence"], 9), -r["length"], r["pattern"], r["start"], r["end"]) for r in charts.best(found).collect()}
    assert chosen == {k: min(v) for k, v in best.items()}
