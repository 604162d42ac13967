"""Queries of the patterns of many bars, with SQL that joins each start with its ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences
from .registry import B, daily, query, rounded

STRETCHES = """, a AS (SELECT *, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY symbol) AS n, abs(close - open) AS b, high - low AS r, high - greatest(open, close) AS us, least(open, close) - low AS ls FROM i WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  m AS (SELECT *, CASE WHEN j >= 4 THEN avg(b) OVER w20 END AS mb, CASE WHEN j >= 4 THEN avg(r) OVER w20 END AS mr, CASE WHEN j >= 4 THEN avg(close) OVER w20 END AS mc, close > open AS bull, close < open AS bear,
    lag(close) OVER w / coalesce(lag(close, 12) OVER w, first_value(close) OVER w) - 1 AS prior,
    coalesce(close > open AND lag(close > open) OVER w AND lag(close > open, 2) OVER w, false) AS bulls3, coalesce(close < open AND lag(close < open) OVER w AND lag(close < open, 2) OVER w, false) AS bears3
    FROM a WINDOW w AS (PARTITION BY symbol ORDER BY j), w20 AS (PARTITION BY symbol ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  pairs AS (SELECT s.symbol, s.j, k, s.n FROM m s, range(3, 30) ks(k) WHERE s.j + k < s.n),
  g AS (SELECT p.symbol, p.j, p.k, any_value(p.n) AS n, count(*) AS t, count(*) FILTER (x.b < 0.8 * x.mb) AS small, count(*) FILTER (x.b > 2 * x.mb) AS large, count(*) FILTER (x.b >= 0.8 * x.mb AND x.b < 2 * x.mb) AS middle,
    count(*) FILTER (x.bull) AS bulls, count(*) FILTER (x.bear) AS bears, count(*) FILTER (x.bulls3 AND x.j >= p.j + 2) AS bull_runs, count(*) FILTER (x.bears3 AND x.j >= p.j + 2) AS bear_runs,
    regr_slope(x.close, x.j) AS slope, coalesce(regr_r2(x.close, x.j), 0) AS r2, avg(coalesce(x.us / nullif(x.r, 0), 0)) AS ups, avg(coalesce(x.ls / nullif(x.r, 0), 0)) AS lows,
    max(x.high) FILTER (x.j > p.j AND x.j < p.j + p.k) AS top, min(x.low) FILTER (x.j > p.j AND x.j < p.j + p.k) AS bottom, count(*) FILTER (x.j > p.j AND x.j < p.j + p.k AND x.b > 0.8 * x.mb) AS loud
    FROM pairs p JOIN m x ON x.symbol = p.symbol AND x.j BETWEEN p.j AND p.j + p.k GROUP BY ALL),
  e AS (SELECT g.*, f.open AS fo, f.high AS fh, f.low AS fl, f.close AS fc, f.b AS fb, f.r AS fr, f.us AS fus, f.ls AS fls, f.mb AS fmb, f.bull AS fbull, f.bear AS fbear, f.prior, f2.b AS fb2, f2.mr AS mr2,
    l.open AS lo, l.close AS lc, l.b AS lb, l.r AS lr, l.us AS lus, l.ls AS lls, l.mb AS lmb, l.mr AS lmr, l.mc AS lmc, l.bull AS lbull, l.bear AS lbear, l0.b AS lb0
    FROM g JOIN m f ON f.symbol = g.symbol AND f.j = g.j JOIN m f2 ON f2.symbol = g.symbol AND f2.j = g.j + 1 JOIN m l ON l.symbol = g.symbol AND l.j = g.j + g.k JOIN m l0 ON l0.symbol = g.symbol AND l0.j = g.j + g.k - 1)"""


def first_ends(pattern: str, direction: str, low: int, high: int, where: str, confidence: str = "r2", note: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT symbol, '{pattern}' AS pattern, '{direction}' AS direction, j AS start_idx, j + min(k) AS end_idx, arg_min({confidence}, k) AS confidence, arg_min({note}, k) AS note FROM e WHERE k BETWEEN {low} AND {high} AND {where} GROUP BY symbol, j"


def both_ways() -> list[str]:
    out = []
    for up in (True, False):
        this, other, more = ("bull", "bear", ">") if up else ("bear", "bull", "<")
        name = lambda a, b: a if up else b  # noqa: B023, E731
        trend = f"slope {more} 0 AND r2 >= 0.3"
        out.append(first_ends(name("gradual_rise", "gradual_decline"), this, 8, 29, f"small / t >= 0.7 AND large = 0 AND {this}s / t >= 0.7 AND {trend}"))
        out.append(first_ends(name("steady_rise", "steady_decline"), this, 6, 29, f"middle / t >= 0.6 AND {this}s / t >= 0.6 AND {other}_runs = 0 AND {trend}"))
        moved, share = "(lc - fc) / greatest(abs(fc), 1e-9)", name("ups", "lows")
        held = f"least(0.92, 0.6 + least(abs(prior), 0.12) + 0.08 * least(bulls, bears) / t + CASE WHEN {share} >= 0.22 THEN 0.08 ELSE 0 END)"
        out.append(first_ends(name("rising_resistance", "falling_resistance"), other, 4, 11, f"j >= 6 AND prior {name('>= 0.025', '<= -0.025')} AND bulls > 0 AND bears > 0 AND {moved} BETWEEN {name('-0.025 AND 0.035', '-0.035 AND 0.025')} AND ((lb0 + lb) / 2 <= 0.85 * (fb + fb2) / 2 OR {share} >= 0.22)", held))
        beyond = f"f{other} AND l{this} AND j + k < n - 1 AND j < n - 5 AND " + ("lc > top" if up else "lc < bottom")
        out.append(first_ends(name("pagoda_bottom", "pagoda_top"), "neutral", 4, 14, f"{beyond} AND lb > lmb AND coalesce(fb >= fmb, true) AND top - bottom < 2 * fb", "0.6"))
        near = "AND lo <= top + 0.6 * CASE WHEN lmr > 0 THEN lmr ELSE greatest(top - bottom, 1e-12) END AND lc - top <= greatest(1.8 * CASE WHEN lmr > 0 THEN lmr ELSE greatest(top - bottom, 1e-12) END, 0.04 * abs(lc))" if up else ""
        out.append(first_ends(name("tower_bottom", "tower_top"), this, 4, 9, f"{beyond} AND fb > 1.5 * fmb AND lb > 1.5 * lmb AND loud = 0 AND top <= fh AND bottom >= fl {near}", "1.0", "CASE WHEN top - bottom < 0.5 * mr2 THEN 'classic' ELSE 'variant' END"))
        keeps, breaks = ("bottom >= fo", "lc > fh * (1 + 0.3 * lmr / lmc)") if up else ("top <= fo", "lc < fl * (1 - 0.3 * lmr / lmc)")
        shadow = name("us", "ls")
        after = f"(SELECT (count(*) = 5 AND coalesce(bool_and(z.close {name('>=', '<=')} z.last_close), true)) OR arg_max(z.close, z.j) {name('>=', '<=')} e.lc FROM (SELECT j, close, CASE WHEN j > e.j + e.k + 1 THEN (SELECT y.close FROM m y WHERE y.symbol = e.symbol AND y.j = x.j - 1) END AS last_close FROM m x WHERE x.symbol = e.symbol AND x.j BETWEEN e.j + e.k + 1 AND e.j + e.k + 5) z)"
        out.append(first_ends(name("bullish_probe", "bearish_probe"), this, 3, 9, f"j < n - 8 AND f{this} AND coalesce(fb >= fmb, true) AND f{shadow} / nullif(fr, 0) > 0.5 AND {keeps} AND l{this} AND coalesce(l{shadow} / nullif(lr, 0), 1) < 0.1 AND {breaks} AND j + k + 5 < n AND ({after})", "1.0"))
    return out


SLOW = """SELECT symbol, pattern, direction, j AS start_idx, arg_min(last, p) AS end_idx, arg_min(r2, p) AS confidence, CAST(j + min(p) AS VARCHAR) AS note FROM (
    SELECT s.symbol, s.j, p, least(s.j + p + 2, s.n - 1) AS last, side.pattern, side.direction, side.sign,
      count(*) FILTER (x.j < s.j + p AND x.b > 0.8 * x.mb) AS above, count(*) FILTER (x.j < s.j + p AND CASE WHEN sign > 0 THEN x.bull ELSE x.bear END) AS early, count(*) FILTER (x.j >= s.j + p AND x.b > 1.5 * x.mb AND CASE WHEN sign > 0 THEN x.bull ELSE x.bear END) AS late,
      regr_slope(x.close, x.j) AS slope, regr_r2(x.close, x.j) AS r2
    FROM m s, range(5, 15) ps(p), (VALUES ('slow_rise', 'bull', 1), ('slow_decline', 'bear', -1)) side(pattern, direction, sign) JOIN m x ON x.symbol = s.symbol AND x.j BETWEEN s.j AND least(s.j + p + 2, s.n - 1)
    WHERE s.j < s.n - 8 AND s.j + p < s.n - 1 GROUP BY ALL) WHERE above <= 0.3 * p AND early >= 0.7 * p AND late = last - j - p + 1 AND slope * sign > 0 AND r2 >= 0.3 GROUP BY symbol, j, pattern, direction"""
FAST = """SELECT symbol, 'acceleration' AS pattern, 'neutral' AS direction, j - 4 AS start_idx, j AS end_idx, 0.8 AS confidence, CASE WHEN slope > 0 THEN 'up' ELSE 'down' END AS note FROM (
    SELECT *, CASE WHEN j >= 9 THEN lag(slope, 5) OVER (PARTITION BY symbol ORDER BY j) ELSE 0 END AS before, lag(body, 2) OVER (PARTITION BY symbol ORDER BY j) AS body2 FROM (
      SELECT symbol, j, n, close, regr_slope(close, j) OVER w5 AS slope, CASE WHEN count(b) OVER w5 >= 3 THEN avg(b) OVER w5 END AS body, min(close) OVER n5 AS lowest, max(close) OVER n5 AS highest
      FROM m WINDOW w5 AS (PARTITION BY symbol ORDER BY j ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), n5 AS (PARTITION BY symbol ORDER BY j ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)))
    WHERE j >= 5 AND j < n - 5 AND body > body2 AND abs(slope) > 1.2 * abs(before) AND CASE WHEN slope > 0 THEN lowest < close ELSE highest > close END"""
ROUND = """SELECT symbol, arg_min(pattern, k) AS pattern, 'neutral' AS direction, j AS start_idx, j + min(k) AS end_idx, 0.6 AS confidence, CAST(NULL AS VARCHAR) AS note FROM (
    SELECT symbol, j, k, CASE WHEN 0.3 < low_at / (k + 1) AND low_at / (k + 1) < 0.7 AND first_off > 0 AND last_off > 0 AND least_off < -spread THEN 'round_bottom'
      WHEN 0.3 < high_at / (k + 1) AND high_at / (k + 1) < 0.7 AND first_off < 0 AND last_off < 0 AND most_off > spread THEN 'round_top' END AS pattern FROM (
      SELECT e.symbol, e.j, e.k, arg_min(x.close - (icept + e.slope * x.j), x.j) AS f, arg_min(x.j - e.j, x.close) AS low_at, arg_max(x.j - e.j, x.close) AS high_at, min(x.close - icept - e.slope * x.j) AS least_off, max(x.close - icept - e.slope * x.j) AS most_off, stddev_pop(x.close - icept - e.slope * x.j) AS spread,
        arg_min(x.close - icept - e.slope * x.j, x.j) AS first_off, arg_max(x.close - icept - e.slope * x.j, x.j) AS last_off
      FROM (SELECT *, (SELECT regr_intercept(y.close, y.j) FROM m y WHERE y.symbol = e.symbol AND y.j BETWEEN e.j AND e.j + e.k) AS icept FROM e WHERE abs(slope) < 0.001 AND k BETWEEN 7 AND 26) e
      JOIN m x ON x.symbol = e.symbol AND x.j BETWEEN e.j AND e.j + e.k GROUP BY ALL)) WHERE pattern IS NOT NULL GROUP BY symbol, j"""
ALL = " UNION ALL ".join([*both_ways(), SLOW, FAST, ROUND])
QUOTED = ", ".join(f"'{p}'" for p in sequences.MERGED)
CAPPED = ", ".join(f"'{p}'" for p in sequences.FIRST_THREE)
TREND_SQL = (
    B + STRETCHES + f""", found AS ({ALL}),
  o AS (SELECT *, max(end_idx) OVER (PARTITION BY symbol, pattern ORDER BY start_idx, end_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM found),
  u AS (SELECT *, sum(CASE WHEN pattern IN ({QUOTED}) AND start_idx <= reached + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, pattern ORDER BY start_idx, end_idx ROWS UNBOUNDED PRECEDING) AS grp FROM o)
  SELECT symbol, pattern, direction, CAST(min(start_idx) AS INTEGER) AS start_idx, CAST(max(end_idx) AS INTEGER) AS end_idx, round(max(confidence), 4) AS confidence, arg_min(note, start_idx) AS note FROM u WHERE pattern NOT IN ({CAPPED}) OR grp <= 3 GROUP BY symbol, pattern, direction, grp"""
)


@query("trend_patterns", TREND_SQL)
def trend_patterns(spark, d):
    return rounded(sequences.detect(daily(spark, d)), "confidence", to=4)


@query(
    "flat_levels",
    B + STRETCHES + """, z AS (SELECT s.symbol, s.j, side, CASE side WHEN 'flat_bottom' THEN min(x.low) ELSE max(x.high) END AS level FROM m s JOIN m x ON x.symbol = s.symbol AND x.j BETWEEN s.j AND s.j + 9, (VALUES ('flat_bottom'), ('flat_top')) t(side) WHERE s.j < s.n - 2 GROUP BY s.symbol, s.j, side)
    SELECT z.symbol, side AS pattern, CASE side WHEN 'flat_bottom' THEN 'bull' ELSE 'bear' END AS direction, CAST(min(x.j) AS INTEGER) AS start_idx, CAST(max(x.j) AS INTEGER) AS end_idx, round(any_value(level), 6) AS level
    FROM z JOIN m x ON x.symbol = z.symbol AND x.j BETWEEN z.j AND z.j + 9 AND abs(CASE side WHEN 'flat_bottom' THEN x.low ELSE x.high END - level) <= 0.003 * x.mr GROUP BY z.symbol, z.j, side HAVING count(*) >= 3""",
)
def flat_levels(spark, d):
    return rounded(sequences.flat_levels(daily(spark, d)), "level").withColumns({c: F.col(c).cast("int") for c in ("start_idx", "end_idx")})
