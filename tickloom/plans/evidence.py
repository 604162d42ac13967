"""Queries of evidence: every bar starts a span, and every symbol has a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars, evidence
from .registry import B, daily, query, rounded

#: Spans of up to 23 bars from every bar; the level is the start's close, confirmed above it for every second bar.
SPANS = """, z AS (SELECT *, CAST(rn - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY symbol) AS n, coalesce(lag(close) OVER w, close) AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM i WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s AS (SELECT symbol, i AS start, least(i + i % 23, n - 1) AS "end", close AS level, i % 2 = 0 AS bullish, n FROM z)
"""


def spans_of(spark, d):
    rows = bars.with_index(daily(spark, d))
    i = F.col("bar_idx")
    return rows.select(F.concat_ws(":", "symbol", i.cast("string")).alias("id"), "symbol", i.alias("start"), (i + i % 23).alias("end"), F.col("close").alias("level"), (i % 2 == 0).alias("bullish"))


@query(
    "span_evidence",
    B + SPANS + """, m AS (
  SELECT s.symbol, s.start, s."end", count(*) AS bar_count, count(*) FILTER (z.close > z.open) AS bullish_bar_count, count(*) FILTER (z.close < z.open) AS bearish_bar_count,
    s."end" - coalesce(max(z.i) FILTER (NOT z.close > z.open), s.start - 1) AS consecutive_bullish_bars, s."end" - coalesce(max(z.i) FILTER (NOT z.close < z.open), s.start - 1) AS consecutive_bearish_bars,
    max(z.high) AS highest, min(z.low) AS lowest, any_value(s.level) AS level, any_value(s.bullish) AS bullish, any_value(s.n) AS n
  FROM s JOIN z ON z.symbol = s.symbol AND z.i BETWEEN s.start AND s."end" GROUP BY s.symbol, s.start, s."end"),
f AS (SELECT symbol, i, min(close) OVER (PARTITION BY symbol ORDER BY i DESC) AS low_after, max(close) OVER (PARTITION BY symbol ORDER BY i DESC) AS high_after,
  max(CASE WHEN i + 2 < n THEN m3 END) OVER (PARTITION BY symbol ORDER BY i DESC) AS above3, min(CASE WHEN i + 2 < n THEN x3 END) OVER (PARTITION BY symbol ORDER BY i DESC) AS below3,
  bool_and(coalesce(nx < close, true)) OVER (PARTITION BY symbol ORDER BY i DESC) AS falls, bool_and(coalesce(nx > close, true)) OVER (PARTITION BY symbol ORDER BY i DESC) AS rises
  FROM (SELECT symbol, i, n, close, lead(close) OVER w AS nx, min(close) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m3, max(close) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS x3 FROM z WINDOW w AS (PARTITION BY symbol ORDER BY i)))
SELECT m.symbol, m.start, m."end", bar_count, bullish_bar_count, bearish_bar_count, consecutive_bullish_bars, consecutive_bearish_bars, round(highest, 6) AS highest, round(lowest, 6) AS lowest,
  n - 1 - "end" AS post_confirmation_bars, n - 1 - "end" >= 2 AND coalesce(falls, false) AS continuation_down, n - 1 - "end" >= 2 AND coalesce(rises, false) AS continuation_up,
  CASE WHEN f.i IS NULL THEN 'none' WHEN bullish AND high_after >= level * 1.03 OR NOT bullish AND low_after <= level * 0.97 THEN 'distance'
    WHEN bullish AND above3 > level OR NOT bullish AND below3 < level THEN 'three closes' ELSE 'none' END AS confirmation,
  round(CASE WHEN f.i IS NULL THEN 0 WHEN bullish THEN high_after / level - 1 ELSE 1 - low_after / level END * 100, 4) AS distance_pct
FROM m LEFT JOIN f ON f.symbol = m.symbol AND f.i = m."end" + 1""",
)
def span_evidence(spark, d):
    found = evidence.span_evidence(spans_of(spark, d), daily(spark, d)).drop("id", "level", "bullish", "after")
    return rounded(rounded(found, "highest", "lowest"), "distance_pct", to=4)


@query(
    "history_evidence",
    B + SPANS + """, u AS (SELECT *, n - rn AS back, abs(close - open) AS body, greatest(high - low, 1e-12) AS width, high - greatest(open, close) AS up, least(open, close) - low AS dn,
    abs(close - open) / close * 100 AS sized, close / pc - 1 AS move, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN low > ph * 1.001 THEN 'up' WHEN high < pl * 0.999 THEN 'down' END AS gap, CASE WHEN low > ph * 1.001 THEN ph WHEN high < pl * 0.999 THEN pl END AS fill FROM z),
  a AS (SELECT symbol, any_value(n) AS bar_count, exp(greatest(-5, least(5, regr_slope(ln(close), i) FILTER (back < 60) * 252))) - 1 AS slope, regr_r2(ln(close), i) FILTER (back < 60) AS r2,
    min(close) AS lo, max(close) AS hi, max(close) FILTER (back = 0) AS now, max(close) FILTER (back = 1) AS was, max(close) FILTER (back = 19) AS was20, avg(tr) FILTER (back < 14) AS atr,
    avg(volume) FILTER (back < 20) AS vol, max(volume) FILTER (back = 0) AS vol0, greatest(0.35, quantile_cont((up + dn) / width, 0.65) FILTER (back < 30)) AS lim,
    greatest(2.5, median(sized) FILTER (back < 20) * 2.5) AS large, median(body) FILTER (back < 3) / greatest(median(body) FILTER (back BETWEEN 3 AND 12), 1e-12) AS bs,
    median(width) FILTER (back < 3) / greatest(median(width) FILTER (back BETWEEN 3 AND 12), 1e-12) AS rs, count(*) FILTER (gap = 'up') AS ups, count(*) FILTER (gap = 'down') AS downs,
    coalesce(max(gap) FILTER (back = 0), 'none') AS last_gap, max(i) FILTER (gap IS NOT NULL) AS gi, arg_max(gap, i) FILTER (gap IS NOT NULL) AS gd, arg_max(fill, i) FILTER (gap IS NOT NULL) AS gf,
    count(*) FILTER (back < 5 AND close > open) AS b5, count(*) FILTER (back < 5 AND close < open) AS s5,
    coalesce(min(back) FILTER (NOT close > open), any_value(n)) AS br, coalesce(min(back) FILTER (NOT close < open), any_value(n)) AS sr FROM u GROUP BY symbol),
  k AS (SELECT a.symbol, count(*) FILTER (back < 10 AND (up + dn) / width >= lim) / 10 AS sf, count(*) FILTER (back < 10 AND up / width >= 0.2) / 10 AS uf, count(*) FILTER (back < 10 AND dn / width >= 0.2) / 10 AS lf,
    count(*) FILTER (back < 10 AND move > 0 AND sized >= large) AS bb, count(*) FILTER (back < 10 AND move < 0 AND sized >= large) AS sb,
    coalesce(bool_or(CASE WHEN i > gi THEN CASE gd WHEN 'up' THEN low <= gf ELSE high >= gf END END), false) AS filled FROM u JOIN a USING (symbol) GROUP BY a.symbol),
  r AS (SELECT *, CASE WHEN slope > 0.08 AND r2 > 0.25 THEN 'up' WHEN slope < -0.08 AND r2 > 0.25 THEN 'down' ELSE 'range' END AS trend FROM a JOIN k USING (symbol) WHERE bar_count >= 5)
SELECT symbol, bar_count, trend, round(slope, 6) AS trend_slope, round(r2, 6) AS trend_r2, round((now - lo) / greatest(hi - lo, 1e-12), 6) AS position_pct, round(atr, 6) AS atr, round(atr / now * 100, 6) AS atr_pct,
  round(vol0 / vol, 6) AS volume_ratio, round(sf, 6) AS shadow_frequency, round(uf, 6) AS upper_shadow_frequency, round(lf, 6) AS lower_shadow_frequency, round(bs, 6) AS body_shrink_ratio, round(rs, 6) AS range_shrink_ratio,
  ups + downs AS gap_count, ups AS up_gap_count, downs AS down_gap_count, last_gap AS last_gap_direction, filled AS last_gap_filled, bb AS big_bullish_count_10, sb AS big_bearish_count_10,
  round((now / was20 - 1) * 100, 6) AS recent_return_pct, b5 AS bullish_bar_count, s5 AS bearish_bar_count, br AS consecutive_bullish_bars, sr AS consecutive_bearish_bars,
  trend = 'down' AND sr >= 2 AND now < was AS continuation_down, trend = 'up' AND br >= 2 AND now > was AS continuation_up FROM r""",
)
def history_evidence(spark, d):
    numbers = ("trend_slope", "trend_r2", "position_pct", "atr", "atr_pct", "volume_ratio", "shadow_frequency", "upper_shadow_frequency", "lower_shadow_frequency", "body_shrink_ratio", "range_shrink_ratio", "recent_return_pct")
    return rounded(evidence.history_evidence(daily(spark, d)), *numbers)
