"""SQL for the candlestick queries, written apart from the detectors.

x is the bar that completes a pattern, p, q, s and t are the four bars before it and
n is the bar after it, each with its own features, joined by row number.
"""

from __future__ import annotations

FEATURES = """, f0 AS (SELECT symbol, ts, rn, open, high, low, close, abs(close - open) AS body, nullif(high - low, 0) AS span, high - low AS width,
      high - greatest(open, close) AS top, least(open, close) - low AS tail, greatest(open, close) AS upper, least(open, close) AS lower, close / nullif(lag(close, 20) OVER w, 0) - 1 AS ret FROM i WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
    g0 AS (SELECT symbol, median(body) AS whole_median FROM f0 GROUP BY symbol),
    f AS (SELECT f0.*,
      CASE WHEN count(body) OVER w20 >= 5 THEN avg(body) OVER w20 END AS body20, CASE WHEN count(*) OVER w20 >= 5 THEN avg(width) OVER w20 END AS span20, CASE WHEN count(*) OVER w20 >= 5 THEN avg(close) OVER w20 END AS close20,
      coalesce(nullif(CASE WHEN count(body) OVER w20 >= 3 THEN median(body) OVER w20 END, 0), whole_median) AS usual,
      CASE WHEN count(*) OVER w10 >= 3 THEN quantile_cont(high, 0.8) OVER w10 END AS h80, CASE WHEN count(*) OVER w10 >= 3 THEN quantile_cont(low, 0.2) OVER w10 END AS l20,
      CASE WHEN count(*) OVER w20 >= 5 THEN quantile_cont(close, 0.8) OVER w20 END AS c80, CASE WHEN count(*) OVER w20 >= 5 THEN quantile_cont(close, 0.2) OVER w20 END AS c20,
      CASE WHEN count(*) OVER p5 >= 3 THEN max(high) OVER p5 END AS top5, CASE WHEN count(*) OVER p5 >= 3 THEN min(low) OVER p5 END AS low5,
      count(*) OVER n5 AS ahead, min(close) OVER n5 AS ahead_close, min(low) OVER n5 AS ahead_low,
      CASE WHEN count(ret) OVER p120 >= 30 AND ret > 0 AND ret >= quantile_cont(ret, 0.75) OVER p120 THEN 'up' WHEN count(ret) OVER p120 >= 30 AND ret < 0 AND ret <= quantile_cont(ret, 0.25) OVER p120 THEN 'down' ELSE '-' END AS trend
      FROM f0 JOIN g0 USING (symbol)
      WINDOW w20 AS (PARTITION BY f0.symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w10 AS (PARTITION BY f0.symbol ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
      p5 AS (PARTITION BY f0.symbol ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), n5 AS (PARTITION BY f0.symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), p120 AS (PARTITION BY f0.symbol ORDER BY rn ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING))"""


def up(bar: str) -> str:
    return f"{bar}.close > {bar}.open"


def down(bar: str) -> str:
    return f"{bar}.close < {bar}.open"


def big(bar: str, times: float = 1) -> str:
    return f"{bar}.body > {times} * {bar}.body20"


def joined(*conditions: str) -> str:
    return " AND ".join(f"({c})" for c in conditions)


def small_body(bar: str, least: float, most: float) -> str:
    return f"{bar}.body / {bar}.span >= {least} AND {bar}.body / {bar}.span < {most}"


ROOM = "greatest(x.span20 / 20, abs(x.close) / 1000)"
HELD = joined(
    f"x.upper - {ROOM} <= p.upper", f"x.lower + {ROOM} >= p.lower", "x.body < 0.55 * x.body20",
    f"(x.high - {ROOM} <= p.upper AND x.low + {ROOM} >= p.lower) OR (x.high - {ROOM} <= p.high AND x.low + {ROOM} >= p.low)",
)
WEIGHT = joined("p.body >= 0.55 * p.usual", "p.body / p.span >= 0.2", "x.body >= 0.55 * x.usual", "x.body / x.span >= 0.2")
RISE, FALL = joined(up("q"), up("p"), up("x"), "q.close < p.close", "p.close < x.close"), joined(down("q"), down("p"), down("x"), "q.close > p.close", "p.close > x.close")
SOLDIERS = joined(RISE, big("q"), big("p"), big("x"), *[f"{b}.tail / nullif({b}.body, 0) < 0.1" for b in "qpx"], "p.open >= q.open + (q.close - q.open) * 0.5", "x.open >= p.open + (p.close - p.open) * 0.5")
BLOCKED = joined(RISE, "q.body > p.body", "p.body > x.body", "q.top < p.top", "p.top < x.top")
SHADOW = [f"{b}.top / {b}.span > 0.05 OR {b}.tail / {b}.span > 0.05" for b in "qpx"]
ORPHAN = joined("p.body / p.span <= 0.08", "q.body / q.span > 0.08", "x.body / x.span > 0.08")
LIKE = "p.body > 0 AND abs(p.body - x.body) / nullif(p.body, 0) <= 0.3"
HAMMER, STAR = "x.tail / x.span > 0.55 AND x.top / x.span < 0.1 AND x.body / x.span < 0.3", "x.top / x.span > 0.55 AND x.tail / x.span < 0.1 AND x.body / x.span < 0.3"

SQL: dict[str, tuple[str, int, str]] = {
    "doji": ("bear", 1, "x.body / x.span < 0.08"),
    "long_legged_doji": ("bear", 1, "x.body / x.span < 0.08 AND x.top > x.span20 * 0.4 AND x.tail > x.span20 * 0.4"),
    "spinning_top": ("bull", 1, joined(small_body("x", 0.08, 0.25), "x.top > x.span20 * 0.15", "x.tail > x.span20 * 0.15")),
    "long_cross": ("neutral", 1, "x.body / x.span < 0.08 AND x.top / x.span > 0.25 AND x.tail / x.span > 0.25"),
    "propeller": ("neutral", 1, joined(small_body("x", 0.08, 0.25), "x.top / x.span > 0.25", "x.tail / x.span > 0.25", "abs(x.top - x.tail) / x.span < 0.1")),
    "t_shape": ("neutral", 1, "x.open = x.close AND x.close = x.high AND x.low < x.close"),
    "inverted_t": ("neutral", 1, "x.open = x.close AND x.close = x.low AND x.high > x.close"),
    "one_line": ("neutral", 1, "x.open = x.close AND x.close = x.high AND x.high = x.low"),
    "shooting_star": ("bear", 1, joined(STAR, "x.high > x.h80")),
    "inverted_hammer": ("bull", 1, joined(STAR, "x.low < x.l20")),
    "hammer": ("bull", 1, joined(HAMMER, "x.low < x.l20", "x.trend = 'down'", "x.ahead = 5", "x.ahead_close >= x.low")),
    "hanging_man": ("neutral", 1, joined(HAMMER, "x.high > x.h80", "x.trend = 'up'", "x.ahead = 5", "x.ahead_low < x.low")),
    "high_open_escape": ("bear", 1, joined(big("x", 1.8), "x.open > x.top5 * (1 + 0.5 * x.span20 / x.close20)", "x.top / x.span < 0.08", "(x.close - x.low) / x.span < 0.15")),
    "low_open_surge": ("bull", 1, joined(big("x", 1.8), "x.open < x.low5 * (1 - 0.5 * x.span20 / x.close20)", "x.tail / x.span < 0.08", "(x.high - x.close) / x.span < 0.15")),
    "bullish_engulfing": ("bull", 2, joined(down("p"), up("x"), WEIGHT, "x.open - 0.0001 * abs(x.close) <= p.close", "x.close + 0.0001 * abs(x.close) >= p.open")),
    "bearish_engulfing": ("bear", 2, joined(up("p"), down("x"), WEIGHT, "x.open + 0.0001 * abs(x.close) >= p.close", "x.close - 0.0001 * abs(x.close) <= p.open")),
    "piercing": ("bull", 2, joined(down("p"), big("p"), up("x"), big("x"), "(x.open - p.close) / abs(p.close) < -0.005", "x.close > (p.open + p.close) / 2", "x.close < p.open - 0.0001 * abs(p.open)", "x.tail / x.span < 0.3")),
    "dark_cloud": ("bear", 2, joined(up("p"), big("p"), down("x"), big("x"), "(x.open - p.close) / abs(p.close) > 0.005", "x.close < (p.open + p.close) / 2", "x.close > p.open + 0.0001 * abs(p.open)", "x.top / x.span < 0.3")),
    "bullish_harami": ("bull", 2, joined(down("p"), HELD)),
    "bearish_harami": ("bear", 2, joined(up("p"), HELD)),
    "harami_cross": ("neutral", 2, joined("p.close <> p.open", HELD, "x.body / x.span < 0.08")),
    "sun": ("bull", 2, joined(down("p"), big("p"), up("x"), big("x"), "p.close - x.open > 0.3 * x.span20", "x.close > p.open")),
    "rain": ("bear", 2, joined(up("p"), big("p"), down("x"), big("x"), "x.open - p.close > 0.3 * x.span20", "x.close < p.open")),
    "meeting_up": ("bull", 2, joined(down("p"), big("p"), up("x"), big("x"), "abs(x.close - p.close) <= 0.05 * x.span20")),
    "meeting_down": ("bear", 2, joined(up("p"), big("p"), down("x"), big("x"), "abs(x.close - p.close) <= 0.05 * x.span20")),
    "twin_bulls": ("bull", 2, joined(up("p"), up("x"), "abs(p.body - x.body) / greatest(p.body, 1e-9) < 0.25")),
    "twin_bears": ("bear", 2, joined(down("p"), down("x"), "abs(p.body - x.body) / greatest(p.body, 1e-9) < 0.25")),
    "tweezer_top": ("bear", 2, joined("abs(x.high - p.high) <= 0.003 * x.span20", "p.close >= p.open", down("x"), "x.close >= x.c80")),
    "tweezer_bottom": ("bull", 2, joined("abs(x.low - p.low) <= 0.003 * x.span20", "p.close <= p.open", up("x"), "x.close <= x.c20")),
    "exhaustion_top": ("bear", 2, joined(big("p"), up("p"), "x.body < 0.5 * x.body20", "x.low >= p.upper", "x.high <= p.high")),
    "exhaustion_bottom": ("bull", 2, joined(big("p"), down("p"), "x.body < 0.5 * x.body20", "x.high <= p.lower", "x.low >= p.low")),
    "kneading": ("neutral", 2, joined("p.body / p.span < 0.25", "x.body / x.span < 0.25", "(p.top / p.span > 0.4 AND x.tail / x.span > 0.4) OR (p.tail / p.span > 0.4 AND x.top / x.span > 0.4)")),
    "gap_twins_high": ("bull", 2, joined("p.low > q.high", "x.low > q.high", up("p"), up("x"), LIKE, "p.close > p.close20", "n.rn IS NOT NULL")),
    "gap_twins_low": ("bull", 2, joined("p.high < q.low", "x.high < q.low", up("p"), up("x"), LIKE, "p.close < p.close20", "n.rn IS NOT NULL")),
    "inverted_two": ("bull", 2, joined("p.trend = 'down'", "q.rn IS NULL OR q.rn >= 0", "p.rn >= 2", up("p"), up("x"), "x.open < p.close", "n.rn IS NOT NULL", f"NOT ({up('n')} AND n.open < x.close)")),
    "morning_star": ("bull", 3, joined(big("q"), down("q"), big("x"), up("x"), "x.close > (q.open + q.close) / 2", "q.width > 0", small_body("p", 0.08, 0.25))),
    "evening_star": ("bear", 3, joined(big("q"), up("q"), big("x"), down("x"), "x.close < (q.open + q.close) / 2", "q.width > 0", small_body("p", 0.08, 0.25))),
    "morning_doji_star": ("bull", 3, joined(big("q"), down("q"), big("x"), up("x"), "x.close > (q.open + q.close) / 2", "q.width > 0", "p.body / p.span < 0.08")),
    "evening_doji_star": ("bear", 3, joined(big("q"), up("q"), big("x"), down("x"), "x.close < (q.open + q.close) / 2", "q.width > 0", "p.body / p.span < 0.08")),
    "morning_doji_cover": ("bull", 3, joined(big("q"), down("q"), "p.body < 0.08 * greatest(p.width, 1e-9)", big("x"), up("x"), "x.close > q.open")),
    "evening_doji_cover": ("bear", 3, joined(big("q"), up("q"), "p.body < 0.08 * greatest(p.width, 1e-9)", big("x"), down("x"), "x.close < q.open")),
    "abandoned_baby_up": ("bull", 3, joined(ORPHAN, down("q"), up("x"), "q.trend = 'down'", "p.high < q.low", "x.low > p.high")),
    "abandoned_baby_down": ("bear", 3, joined(ORPHAN, up("q"), down("x"), "q.trend = 'up'", "p.low > q.high", "x.high < p.low")),
    "three_red": ("neutral", 3, joined(RISE, *[f"{b}.top / nullif({b}.body, 0) < 0.1" for b in "qpx"], "p.open >= q.open", "p.open <= q.close", "x.open >= p.open", "x.open <= p.close")),
    "white_soldiers": ("bull", 3, SOLDIERS),
    "advance_block": ("neutral", 3, f"{BLOCKED} AND NOT ({SOLDIERS})"),
    "deliberation": ("neutral", 3, joined(RISE, big("q"), big("p"), "x.body < 0.5 * x.body20", *SHADOW, f"NOT ({BLOCKED})", f"NOT ({SOLDIERS})")),
    "three_falling": ("bear", 3, FALL),
    "black_three": ("bear", 3, joined(FALL, *[f"{b}.body < {b}.body20" for b in "qpx"], "p.open >= q.open", "p.open <= q.close", "x.open >= p.open", "x.open <= p.close")),
    "three_crows": ("bear", 3, joined(FALL, *[f"{b}.body >= {b}.body20 AND {b}.tail / nullif({b}.body, 0) < 0.1" for b in "qpx"])),
    "cover_down": ("bear", 3, joined(down("q"), up("p"), down("x"), "x.close < p.open", "n.rn IS NOT NULL")),
    "cover_up": ("bull", 3, joined(up("q"), down("p"), up("x"), "x.close > p.open", "n.rn IS NOT NULL")),
    "two_up_one_down": ("bull", 3, joined(up("q"), up("p"), down("x"), "x.close > q.close")),
    "two_down_one_up": ("bear", 3, joined(down("q"), down("p"), up("x"), "x.close < q.close")),
    "limping": ("bear", 3, joined("q.rn > 1", "q.close >= q.c80", up("q"), up("p"), up("x"), "q.close > p.close", "p.close > x.close")),
    "inverted_three": ("bull", 3, joined("q.rn > 1", "q.trend = 'down'", up("q"), up("x"), f"({up('p')} AND p.open < q.close AND x.open < p.close) OR ({down('p')} AND x.open < q.close)")),
    "two_crows": ("bear", 3, joined("q.close >= q.open", "q.close >= q.c80", down("p"), "p.open > q.close", "p.close >= q.open", down("x"), "x.open > p.open", "x.close < p.close")),
    "three_gap_rise": ("bull", 3, joined(up("q"), up("p"), up("x"), "p.open > q.close", "x.open > p.close")),
    "three_gap_decline": ("bear", 3, joined(down("q"), down("p"), down("x"), "p.open < q.close", "x.open < p.close")),
    "three_tweezers": ("neutral", 3, joined(big("q"), big("x"), "p.body < 0.5 * p.body20", f"({up('q')} AND {down('x')} AND greatest(abs(q.high - p.high), abs(p.high - x.high)) <= 0.003 * x.span20) OR ({down('q')} AND {up('x')} AND greatest(abs(q.low - p.low), abs(p.low - x.low)) <= 0.003 * x.span20)")),
    "rising_three_methods": ("bull", 5, joined(up("t"), big("t"), up("x"), big("x"), f"CAST({down('s')} AS INT) + CAST({down('q')} AS INT) + CAST({down('p')} AS INT) > 1", "s.low >= t.open", "q.low >= t.open", "p.low >= t.open", "x.close > s.high", "x.close > q.high", "x.close > p.high")),
    "falling_three_methods": ("bear", 5, joined(down("t"), big("t"), down("x"), big("x"), f"CAST({up('s')} AS INT) + CAST({up('q')} AS INT) + CAST({up('p')} AS INT) > 1", "s.high <= t.open", "q.high <= t.open", "p.high <= t.open", "x.close < s.low", "x.close < q.low", "x.close < p.low")),
    "falling_three_stars": ("bear", 5, joined(down("t"), big("t", 1.5), down("x"), big("x", 1.5), *[f"{b}.body < 0.8 * {b}.body20 AND {b}.high < t.low AND x.close < {b}.low" for b in "sqp"])),
}


def candle_sql(base: str, bars: int | None = None) -> str:
    """Hits of the patterns of so many bars, or of all."""
    before = "".join(f" LEFT JOIN f {a} ON {a}.symbol = x.symbol AND {a}.rn = x.rn {k}" for a, k in (("p", "- 1"), ("q", "- 2"), ("s", "- 3"), ("t", "- 4"), ("n", "+ 1")))
    hits = ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, (_, n, sql) in SQL.items() if bars in (None, n))
    known = ", ".join(f"('{name}', '{direction}', {n})" for name, (direction, n, _) in SQL.items())
    return base + FEATURES + f", hits AS (SELECT x.symbol, x.ts, unnest([{hits}]) AS pattern FROM f x{before}), known(pattern, direction, bars) AS (VALUES {known}) SELECT symbol, ts, pattern, direction, bars FROM hits JOIN known USING (pattern)"
