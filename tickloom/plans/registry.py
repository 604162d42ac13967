"""The queries: each with its Spark plan and, where SQL can say it, the SQL for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quantiles
from ..functions import rolling as R
from ..operators import averages, bars, candles, chan, events, factors, indicators, retrieval, search, structure, valuation
from ..sources import bars as sources
from ..streaming import bars as streaming
from . import candle_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TICK_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
B = f"""WITH RECURSIVE t AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size, {TICK_ORDER} FROM lineitem
), b AS (
  SELECT symbol, ts, first(price ORDER BY {TICK_ORDER}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {TICK_ORDER}) AS close, sum(size) AS volume
  FROM t WHERE price > 0 GROUP BY symbol, ts
), i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM b)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.build(sources.lineitem_ticks(spark, sf_dir))


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


OHLC = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close"


@query("bars_daily", B + f"SELECT symbol, ts, {OHLC}, volume FROM b")
def bars_daily(spark, d):
    return rounded(daily(spark, d), "open", "high", "low", "close")


@query(
    "bars_hourly",
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY events.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value > 0 GROUP BY event_type, date_trunc('hour', ts)""",
)
def bars_hourly(spark, d):
    return bars.build(sources.event_ticks(spark, d))


@query(
    "bars_orders",
    """SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS ts, first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    last(o_totalprice ORDER BY o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders WHERE o_totalprice > 0 GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
)
def bars_orders(spark, d):
    return bars.build(sources.order_ticks(spark, d))


def resampled(label: str) -> str:
    return B + f"SELECT symbol, {label} AS ts, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close, sum(volume) AS volume FROM b GROUP BY symbol, {label}"


@query("bars_weekly", resampled("CAST(ts + CAST((12 - isodow(ts)) % 7 AS INTEGER) AS DATE)"))
def bars_weekly(spark, d):
    return rounded(bars.resample(daily(spark, d), "week"), "open", "high", "low", "close")


@query("bars_monthly", resampled("CAST(last_day(ts) AS DATE)"))
def bars_monthly(spark, d):
    return rounded(bars.resample(daily(spark, d), "month"), "open", "high", "low", "close")


@query(
    "clean_dedup_last",
    """WITH r AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS ts, value AS open, value * 1.01 AS high, value * 0.99 AS low, value AS close, 1.0 AS volume, event_id FROM events)
    SELECT symbol, ts, round(close, 6) AS close, event_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id DESC) AS rn FROM r
    WHERE close > 0 AND high >= greatest(open, close) AND low <= least(open, close)) WHERE rn = 1""",
)
def clean_dedup_last(spark, d):
    v = F.col("value")
    rows = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("ts"), v.alias("open"), (v * 1.01).alias("high"), (v * 0.99).alias("low"), v.alias("close"), F.lit(1.0).alias("volume"), "event_id")
    return rounded(bars.clean(rows, "event_id").select("symbol", "ts", "close", "event_id"), "close")


@query("bars_tail", B + "SELECT symbol, ts, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b) WHERE k <= 120")
def bars_tail(spark, d):
    return rounded(bars.tail(daily(spark, d), 120).select("symbol", "ts", "close"), "close")


@query(
    "asof_long_ma",
    B
    + """, m AS (SELECT symbol, ts, CASE WHEN count(close) OVER w = 250 THEN avg(close) OVER w END AS long_ma FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)),
    k AS (SELECT symbol, CAST(ts + CAST((12 - isodow(ts)) % 7 AS INTEGER) AS DATE) AS ts, last(close ORDER BY ts) AS close FROM b GROUP BY 1, 2)
    SELECT k.symbol, k.ts, round(k.close, 6) AS close, round(m.long_ma, 6) AS long_ma FROM k ASOF LEFT JOIN (SELECT * FROM m WHERE long_ma IS NOT NULL) m ON k.symbol = m.symbol AND k.ts >= m.ts""",
)
def asof_long_ma(spark, d):
    base = daily(spark, d)
    weekly = bars.resample(base, "week").select("symbol", "ts", "close")
    return rounded(bars.as_of(weekly, bars.long_average(base).select("symbol", "ts", "long_ma"), "long_ma"), "close", "long_ma")


def over(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("sma_min_periods", B + f"SELECT symbol, ts, round(CASE WHEN count(close) OVER {over(20)} >= 20 THEN avg(close) OVER {over(20)} END, 6) AS sma20, round(CASE WHEN count(close) OVER {over(20)} >= 5 THEN avg(close) OVER {over(20)} END, 6) AS sma20_5 FROM b")
def sma_min_periods(spark, d):
    c = F.col("close")
    return rounded(daily(spark, d).select("symbol", "ts", R.sma(c, 20).alias("sma20"), R.sma(c, 20, 5).alias("sma20_5")), "sma20", "sma20_5")


@query("rolling_quantile", B + f"SELECT symbol, ts, round(CASE WHEN count(close) OVER {over(20)} >= 5 THEN quantile_cont(close, 0.8) OVER {over(20)} END, 6) AS q80, round(CASE WHEN count(close) OVER {over(20)} >= 5 THEN quantile_cont(close, 0.5) OVER {over(20)} END, 6) AS q50 FROM b")
def rolling_quantile(spark, d):
    c = F.col("close")
    return rounded(daily(spark, d).select("symbol", "ts", R.rolling_quantile(c, 0.8, 20, 5).alias("q80"), R.rolling_quantile(c, 0.5, 20, 5).alias("q50")), "q80", "q50")


@query("rolling_regression", B + f"SELECT symbol, ts, round(regr_slope(close, rn) OVER {over(20)}, 5) AS slope, round(regr_r2(close, rn) OVER {over(20)}, 5) AS r2 FROM i WHERE true QUALIFY rn >= 20")
def rolling_regression(spark, d):
    rows = daily(spark, d).withColumn("rn", F.row_number().over(R.ordered()))
    w = R.trailing(20)
    out = rows.select("symbol", "ts", "rn", F.regr_slope("close", "rn").over(w).alias("slope"), F.regr_r2("close", "rn").over(w).alias("r2")).where("rn >= 20").drop("rn")
    return rounded(out, "slope", "r2", to=5)


@query("rolling_volatility", B + f", r AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM b) SELECT symbol, ts, round(CASE WHEN count(ret) OVER {over(60)} >= 60 THEN stddev_samp(ret) OVER {over(60)} END, 6) AS vol FROM r")
def rolling_volatility(spark, d):
    rows = daily(spark, d).select("symbol", "ts", R.simple_return().alias("ret"))
    return rounded(rows.select("symbol", "ts", R.gated(F.stddev_samp("ret").over(R.trailing(60)), F.col("ret"), 60).alias("vol")), "vol")


@query("average_true_range", B + f", r AS (SELECT symbol, ts, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, ts, round(avg(tr) OVER {over(14)}, 6) AS atr FROM r")
def average_true_range(spark, d):
    rows = daily(spark, d).select("symbol", "ts", R.true_range().alias("tr"))
    return rounded(rows.select("symbol", "ts", F.avg("tr").over(R.trailing(14)).alias("atr")), "atr")


WEALTH = """, f AS (SELECT symbol, ts, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts), 1.0) AS factor FROM b),
    g AS (SELECT symbol, ts, product(factor) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS wealth FROM f),
    h AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM g)"""


@query("cumulative_wealth", B + WEALTH + " SELECT symbol, ts, round(wealth, 6) AS wealth, round(drawdown, 6) AS drawdown FROM h")
def cumulative_wealth(spark, d):
    return rounded(structure.wealth(daily(spark, d)).select("symbol", "ts", "wealth", "drawdown"), "wealth", "drawdown")


@query("max_drawdown", B + WEALTH + " SELECT symbol, round(min(drawdown), 6) AS max_drawdown FROM h GROUP BY symbol")
def max_drawdown(spark, d):
    return rounded(structure.wealth(daily(spark, d)).groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown")), "max_drawdown")


@query(
    "run_lengths",
    B
    + """, s AS (SELECT symbol, ts, CAST(sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS DOUBLE) AS sign FROM b), u AS (SELECT * FROM s WHERE sign IS NOT NULL),
    v AS (SELECT *, CASE WHEN sign IS NOT DISTINCT FROM lag(sign) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS new FROM u),
    w AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM v)
    SELECT symbol, CAST(run AS BIGINT) AS run, sign, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS length FROM w GROUP BY symbol, run, sign""",
)
def run_lengths(spark, d):
    return structure.runs(daily(spark, d))


@query("trend_context", B + candle_sql.FEATURES + " SELECT symbol, ts, CASE trend WHEN 'up' THEN 'uptrend' WHEN 'down' THEN 'downtrend' ELSE 'neutral' END AS context, round(ret, 6) AS ret FROM f")
def trend_context(spark, d):
    rows = daily(spark, d).select("symbol", "ts", (F.try_divide("close", F.lag("close", 20).over(R.ordered())) - 1).alias("ret"))
    rows = quantiles.with_quantiles(rows.select("symbol", "ts", "ret"), quantiles.RETURNS)
    return rounded(rows.select("symbol", "ts", quantiles.trend_state(F.col("ret")).alias("context"), "ret"), "ret")


def recursion(columns: str, first: str, step: str, out: str, source: str = "i") -> str:
    return B + f", e({columns}) AS (SELECT {first} FROM {source} x WHERE rn = 1 UNION ALL SELECT {step} FROM e JOIN {source} x ON x.symbol = e.symbol AND x.rn = e.rn + 1) SELECT {out} FROM e"


@query("ewm", recursion("symbol, rn, ts, close, y", "symbol, rn, ts, close, close", "x.symbol, x.rn, x.ts, x.close, e.y + (x.close - e.y) * 2.0 / 13", "symbol, ts, round(close, 6) AS close, round(y, 5) AS ema"))
def ewm(spark, d):
    return rounded(rounded(indicators.ewm(daily(spark, d)), "close"), "ema", to=5)


FAST, SLOW = "(e.f + (x.close - e.f) * 2.0 / 13)", "(e.s + (x.close - e.s) * 2.0 / 27)"


@query("macd", recursion("symbol, rn, ts, f, s, dea", "symbol, rn, ts, close, close, 0.0::DOUBLE", f"x.symbol, x.rn, x.ts, {FAST}, {SLOW}, e.dea + ({FAST} - {SLOW} - e.dea) * 0.2", "symbol, ts, round(f - s, 5) AS dif, round(dea, 5) AS dea, round(2 * (f - s - dea), 5) AS hist"))
def macd(spark, d):
    return rounded(indicators.macd(daily(spark, d)).drop("close"), "dif", "dea", "hist", to=5)


RSI_SOURCE = "(SELECT symbol, rn - 1 AS rn, ts, greatest(delta, 0) AS up, greatest(-delta, 0) AS down FROM (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS delta FROM i) WHERE delta IS NOT NULL)"


@query("rsi", recursion("symbol, rn, ts, g, l", "symbol, rn, ts, up, down", "x.symbol, x.rn, x.ts, e.g + (x.up - e.g) / 14, e.l + (x.down - e.l) / 14", "symbol, ts, round(coalesce(100 - 100 / (1 + g / nullif(l, 0)), 50), 4) AS rsi", RSI_SOURCE) + " UNION ALL SELECT symbol, ts, 50.0 FROM i WHERE rn = 1")
def rsi(spark, d):
    return rounded(indicators.rsi(daily(spark, d)).drop("close"), "rsi", to=4)


KDJ_SOURCE = "(SELECT symbol, ts, rn, CASE WHEN rn < 9 OR max(high) OVER w = min(low) OVER w THEN 50.0 ELSE (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) * 100 END AS rsv FROM i WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))"
K_NEXT = "(e.k + (x.rsv - e.k) / 3)"


@query("kdj", recursion("symbol, rn, ts, k, d", "symbol, rn, ts, rsv, rsv", f"x.symbol, x.rn, x.ts, {K_NEXT}, e.d + ({K_NEXT} - e.d) / 3", "symbol, ts, round(k, 5) AS k, round(d, 5) AS d, round(3 * k - 2 * d, 5) AS j", KDJ_SOURCE))
def kdj(spark, d):
    return rounded(indicators.kdj(daily(spark, d)).drop("close"), "k", "d", "j", to=5)


@query("supertrend")
def supertrend(spark, d):
    return rounded(indicators.supertrend(daily(spark, d)).drop("close"), "line", to=5)


CROSS = f", s AS (SELECT symbol, ts, rn, close, CASE WHEN count(close) OVER {over(10)} >= 10 AND count(close) OVER {over(30)} >= 30 AND avg(close) OVER {over(10)} >= avg(close) OVER {over(30)} THEN 1 ELSE 0 END AS signal FROM i)"


@query("ma_cross_signal", B + CROSS + " SELECT symbol, ts, signal FROM s")
def ma_cross_signal(spark, d):
    return averages.crossing(daily(spark, d), 10, 30).select("symbol", "ts", "signal")


@query("signal_transitions", B + CROSS + ", c AS (SELECT *, lag(signal) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM s), k AS (SELECT symbol, ts, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS INTEGER) AS rank, signal FROM c WHERE rn > (SELECT max(rn) FROM s z WHERE z.symbol = c.symbol) - 80 AND prev <> signal) SELECT * FROM k WHERE rank <= 8")
def signal_transitions(spark, d):
    return indicators.transitions(averages.crossing(daily(spark, d), 10, 30))


@query(
    "backtest_metrics",
    B
    + CROSS
    + """, p AS (SELECT *, coalesce(lag(signal) OVER w, 0) AS before, coalesce((close / lag(close) OVER w - 1) * lag(signal) OVER w, 0) AS strategy FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    q AS (SELECT *, product(1 + greatest(strategy, -0.99)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM p),
    u AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 1e-12) - 1 AS dd FROM q),
    x AS (SELECT e.symbol, e.close AS entry, coalesce((SELECT arg_min(z.close, z.rn) FROM p z WHERE z.symbol = e.symbol AND z.rn > e.rn AND z.signal = 0 AND z.before = 1), (SELECT arg_max(z.close, z.rn) FROM p z WHERE z.symbol = e.symbol)) AS leave FROM p e WHERE e.signal = 1 AND e.before = 0),
    y AS (SELECT symbol, count(*) AS trades, avg(CASE WHEN leave > entry THEN 1.0 ELSE 0.0 END) AS win_rate FROM x GROUP BY symbol),
    m AS (SELECT symbol, sum(CASE WHEN strategy > 0 THEN strategy ELSE 0 END) / greatest(sum(CASE WHEN strategy < 0 THEN -strategy ELSE 0 END), 1e-9) AS pf, (arg_max(equity, ts) - 1) * 100 AS ret, min(dd) * 100 AS dd FROM u GROUP BY symbol)
    SELECT symbol, round(pf, 5) AS profit_factor, round(ret, 5) AS return_pct, round(dd, 5) AS drawdown_pct, trades, round(win_rate, 5) AS win_rate,
    round((least(pf, 8) * 0.5 + win_rate * 2 + greatest(ret, -80) / 100 + dd / 180) * least(1.0, trades / 5), 5) AS score FROM m JOIN y USING (symbol)""",
)
def backtest_metrics(spark, d):
    return rounded(indicators.backtest(averages.crossing(daily(spark, d), 10, 30)), "profit_factor", "return_pct", "drawdown_pct", "win_rate", "score", to=5)


@query(
    "information_discreteness",
    B
    + """, r AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM r WHERE ret IS NOT NULL),
    z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(ret) DESC) AS big FROM k WHERE n <= 60)
    SELECT symbol, round(CASE WHEN product(1 + ret) >= 1 THEN 1 ELSE -1 END * (avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0 END) - avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END)), 6) AS discreteness, round(sum(CASE WHEN big <= 5 THEN abs(ret) END) / sum(abs(ret)), 6) AS top5_share FROM z GROUP BY symbol""",
)
def information_discreteness(spark, d):
    return rounded(indicators.discreteness(daily(spark, d)), "discreteness", "top5_share")


def search_query(kind: str) -> None:
    @query(f"search_{kind}")
    def run(spark, d):
        return rounded(search.search(daily(spark, d), kind), "score", "profit_factor", "win_rate", "return_pct", "drawdown_pct", to=5)


for kind in search.GRIDS:
    search_query(kind)


@query("single_averages")
def single_averages(spark, d):
    return search.single_averages(daily(spark, d), adaptive=True)


@query("double_averages")
def double_averages(spark, d):
    base = daily(spark, d)
    return search.double_averages(base, search.single_averages(base))


@query("triple_averages")
def triple_averages(spark, d):
    base = daily(spark, d)
    singles = search.single_averages(base)
    return search.triple_averages(base, singles, search.double_averages(base, singles))


@query("center_average")
def center_average(spark, d):
    return rounded(averages.center_average(daily(spark, d), 10), "above")


@query("safety_lines")
def safety_lines(spark, d):
    return rounded(averages.safety_lines(daily(spark, d)), "value", "recovery")


@query("chan_signals")
def chan_signals(spark, d):
    return rounded(chan.signals(daily(spark, d)), "price")


@query(
    "discreteness_history",
    B
    + """, r AS (SELECT symbol, ts, rn, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM i), p AS (SELECT x.symbol, x.ts, y.ret, row_number() OVER (PARTITION BY x.symbol, x.ts ORDER BY abs(y.ret) DESC) AS big FROM r x JOIN r y ON y.symbol = x.symbol AND y.rn BETWEEN x.rn - 59 AND x.rn WHERE x.rn > 60 AND y.ret IS NOT NULL)
    SELECT symbol, ts, round(CASE WHEN product(1 + ret) >= 1 THEN 1 ELSE -1 END * (avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0 END) - avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END)), 6) AS discreteness, round(sum(CASE WHEN big <= 5 THEN abs(ret) END) / greatest(sum(abs(ret)), 1e-12) * 100, 5) AS top5_pct FROM p GROUP BY symbol, ts""",
)
def discreteness_history(spark, d):
    return rounded(rounded(indicators.discreteness_history(daily(spark, d)), "discreteness"), "top5_pct", to=5)


def candle_query(group: str, bars: int) -> None:
    @query(f"candle_{group}", candle_sql.candle_sql(B, bars))
    def run(spark, d):
        return candles.detect(daily(spark, d), group)


for group, size in (("single", 1), ("two_bar", 2), ("three_bar", 3), ("five_bar", 5)):
    candle_query(group, size)


@query(
    "candle_strongest",
    "WITH hits AS (" + candle_sql.candle_sql(B) + f"), ranks AS (SELECT unnest({list(candles.PRIORITY)}) AS pattern, generate_subscripts({list(candles.PRIORITY)}, 1) AS rank), r AS (SELECT hits.*, rank, min(rank) OVER (PARTITION BY symbol, ts) AS best FROM hits LEFT JOIN ranks USING (pattern)) SELECT symbol, ts, pattern, direction, bars FROM r WHERE rank = best OR best IS NULL",
)
def candle_strongest(spark, d):
    return candles.strongest(candles.detect(daily(spark, d)))


HOURLY = """WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY events.ts, event_id) AS close FROM events WHERE value > 0 GROUP BY event_type, date_trunc('hour', ts)),
    i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx, lag(high) OVER (PARTITION BY symbol ORDER BY ts) AS ph, lag(low) OVER (PARTITION BY symbol ORDER BY ts) AS pl FROM b),
    g AS (SELECT symbol, ts, bar_idx, CASE WHEN low > ph THEN 'up' ELSE 'down' END AS direction, CASE WHEN low > ph THEN ph ELSE high END AS bottom, CASE WHEN low > ph THEN low ELSE pl END AS top FROM i WHERE low > ph OR high < pl)"""


@query(
    "gaps_fill",
    HOURLY
    + """ SELECT symbol, ts, CAST(bar_idx AS INTEGER) AS bar_idx, direction, round(bottom, 6) AS bottom, round(top, 6) AS top, CAST((SELECT min(i.bar_idx) FROM i WHERE i.symbol = g.symbol AND i.bar_idx > g.bar_idx
    AND CASE WHEN g.direction = 'up' THEN i.low <= g.bottom ELSE i.high >= g.top END) AS INTEGER) AS filled_idx FROM g""",
)
def gaps_fill(spark, d):
    return rounded(structure.gaps(bars.build(sources.event_ticks(spark, d))).select("symbol", "ts", "bar_idx", "direction", "bottom", "top", "filled_idx"), "bottom", "top")


@query(
    "window_support",
    HOURLY
    + """, u AS (SELECT g.*, (SELECT min(i.bar_idx) FROM i WHERE i.symbol = g.symbol AND i.bar_idx > g.bar_idx AND CASE WHEN g.direction = 'up' THEN i.low <= g.bottom ELSE i.high >= g.top END) AS filled FROM g)
    SELECT u.symbol, u.ts, u.direction, CAST(filled AS INTEGER) AS filled_idx, CASE WHEN (SELECT count(*) FROM i WHERE i.symbol = u.symbol AND i.bar_idx BETWEEN filled + 1 AND filled + 5) = 5 THEN
      CASE WHEN u.direction = 'up' THEN (SELECT min(i.low) FROM i WHERE i.symbol = u.symbol AND i.bar_idx BETWEEN filled + 1 AND filled + 5) >= f.low ELSE (SELECT max(i.high) FROM i WHERE i.symbol = u.symbol AND i.bar_idx BETWEEN filled + 1 AND filled + 5) <= f.high END END AS held
    FROM u LEFT JOIN i f ON f.symbol = u.symbol AND f.bar_idx = filled""",
)
def window_support(spark, d):
    return structure.window_support(bars.build(sources.event_ticks(spark, d))).select("symbol", "ts", "direction", "filled_idx", "held")


@query("all_patterns")
def all_patterns(spark, d):
    return events.detect_all(daily(spark, d))


@query("islands", HOURLY + ", p AS (SELECT *, lead(bar_idx) OVER w AS e, lead(direction) OVER w AS ed FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)) SELECT symbol, CAST(bar_idx AS INTEGER) AS start_idx, CAST(e AS INTEGER) AS end_idx, CASE WHEN direction = 'up' THEN 'top' ELSE 'bottom' END AS kind FROM p WHERE ed <> direction AND e - bar_idx <= 9")
def islands(spark, d):
    return structure.islands(bars.build(sources.event_ticks(spark, d)))


PIVOTS = """, p AS (SELECT symbol, ts, rn - 1 AS bar_idx, close, high, low, count(*) OVER w AS n, max(high) OVER w AS hi, min(low) OVER w AS lo FROM i WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
    v AS (SELECT symbol, ts, bar_idx, 'high' AS kind, high AS price FROM p WHERE n = 11 AND high = hi UNION ALL SELECT symbol, ts, bar_idx, 'low', low FROM p WHERE n = 11 AND low = lo)"""


@query("pivots_raw", B + PIVOTS + " SELECT symbol, ts, CAST(bar_idx AS INTEGER) AS bar_idx, kind, round(price, 6) AS price FROM v")
def pivots_raw(spark, d):
    return rounded(structure.pivots(daily(spark, d)), "price")


@query(
    "levels",
    B
    + PIVOTS
    + """, e AS (SELECT symbol, last(close ORDER BY ts) AS last_close FROM b GROUP BY symbol), s AS (SELECT v.*, last_close, CASE WHEN price > last_close THEN 'resistance' ELSE 'support' END AS side FROM v JOIN e USING (symbol) WHERE price <> last_close),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY abs(price - last_close), bar_idx) AS INTEGER) AS rank FROM s) SELECT symbol, side, rank, CAST(bar_idx AS INTEGER) AS bar_idx, round(price, 6) AS price FROM k WHERE rank <= 3""",
)
def levels(spark, d):
    return rounded(structure.levels(daily(spark, d)), "price")


@query(
    "interval_merge",
    """WITH r AS (SELECT user_id AS k, CAST(event_id % 5000 AS BIGINT) AS start_idx, CAST(event_id % 5000 + event_id % 90 AS BIGINT) AS end_idx FROM events),
    m AS (SELECT *, max(end_idx) OVER (PARTITION BY k ORDER BY start_idx, end_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r),
    g AS (SELECT *, sum(CASE WHEN top IS NULL OR start_idx > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start_idx, end_idx ROWS UNBOUNDED PRECEDING) AS grp FROM m)
    SELECT k, min(start_idx) AS start_idx, max(end_idx) AS end_idx, count(*) AS n FROM g GROUP BY k, grp""",
)
def interval_merge(spark, d):
    e = F.col("event_id")
    return structure.merge_ranges(table(spark, d, "events").select(F.col("user_id").alias("k"), (e % 5000).alias("start_idx"), (e % 5000 + e % 90).alias("end_idx")), "k")


BIAS = f", c AS (SELECT symbol, ts, close, CASE WHEN count(close) OVER {over(60)} = 60 THEN avg(close) OVER {over(60)} END AS center FROM b), d AS (SELECT symbol, ts, (close / center - 1) * 100 AS bias FROM c WHERE center IS NOT NULL)"


@query("bias_zone", B + BIAS + ", l AS (SELECT symbol, last(bias ORDER BY ts) AS cur FROM d GROUP BY symbol), p AS (SELECT symbol, cur, avg(CASE WHEN bias <= cur THEN 1.0 ELSE 0 END) * 100 AS pct FROM d JOIN l USING (symbol) GROUP BY symbol, cur) SELECT symbol, round(cur, 5) AS current, round(pct, 5) AS percentile, CASE WHEN pct >= 85 THEN 'hot' WHEN pct <= 20 THEN 'cold' ELSE 'normal' END AS zone FROM p")
def bias_zone(spark, d):
    return rounded(averages.bias_zone(daily(spark, d)), "current", "percentile", to=5)


@query("bias_histogram", B + BIAS + ", q AS (SELECT symbol, quantile_cont(bias, 0.02) AS lo, quantile_cont(bias, 0.98) AS hi FROM d GROUP BY symbol) SELECT symbol, CAST(least(11, floor((bias - lo) / (hi - lo) * 12)) AS BIGINT) AS bin, count(*) AS n FROM d JOIN q USING (symbol) WHERE bias >= lo AND bias <= hi AND hi > lo GROUP BY 1, 2")
def bias_histogram(spark, d):
    return averages.bias_histogram(daily(spark, d))


@query(
    "ma_valley",
    B
    + f""", m AS (SELECT symbol, ts, rn, close, CASE WHEN rn >= 5 THEN avg(close) OVER {over(5)} END AS m5, CASE WHEN rn >= 10 THEN avg(close) OVER {over(10)} END AS m10, CASE WHEN rn >= 30 THEN avg(close) OVER {over(30)} END AS m30 FROM i),
    a AS (SELECT *, coalesce(m5 >= m10 AND m10 >= m30, false) AS al FROM m), o AS (SELECT *, al AND NOT coalesce(lag(al) OVER (PARTITION BY symbol ORDER BY ts), false) AS onset FROM a),
    f AS (SELECT *, first(rn) OVER w AS fi, first(close) OVER w AS fc FROM o WHERE onset WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    k AS (SELECT symbol, ts, round(close, 6) AS close, CASE WHEN rn = fi THEN 'silver' WHEN rn - fi >= 5 AND close >= fc THEN 'golden' END AS kind FROM f) SELECT * FROM k WHERE kind IS NOT NULL""",
)
def ma_valley(spark, d):
    return rounded(averages.valleys(daily(spark, d)), "close")


@query("ma_state", B + f", m AS (SELECT symbol, ts, rn, close, CASE WHEN rn >= 60 THEN avg(close) OVER {over(60)} END AS ma FROM i), p AS (SELECT *, lag(ma) OVER (PARTITION BY symbol ORDER BY ts) AS pm FROM m) SELECT symbol, CASE WHEN close > ma AND ma > pm THEN 'bullish' WHEN close < ma AND ma < pm THEN 'bearish' ELSE 'mixed' END AS state FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def ma_state(spark, d):
    return averages.state(daily(spark, d))


RETURNS = ", r AS (SELECT symbol, ts, close, volume, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM r WHERE ret IS NOT NULL)"


@query(
    "factor_exposures",
    B
    + RETURNS
    + """ SELECT symbol, round(CASE WHEN count(*) >= 273 THEN product(1 + ret) FILTER (k BETWEEN 22 AND 252) - 1 END, 5) AS momentum_12_1, round(CASE WHEN count(*) >= 126 THEN product(1 + ret) FILTER (k BETWEEN 22 AND 126) - 1 END, 5) AS momentum_6_1,
    round(CASE WHEN count(*) >= 21 THEN product(1 + ret) FILTER (k <= 21) - 1 END, 5) AS reversal, round(stddev_samp(ret) FILTER (k <= 60) * sqrt(252.0), 5) AS realized_vol, round(CASE WHEN count(*) >= 60 THEN skewness(ret) END, 5) AS skewness, round(CASE WHEN count(*) >= 60 THEN kurtosis(ret) END, 5) AS kurtosis,
    round(corr(volume, close) FILTER (k <= 60), 5) AS volume_price_corr, round(avg(volume) FILTER (k <= 20) / avg(volume) FILTER (k <= 60), 5) AS volume_activity FROM n GROUP BY symbol""",
)
def factor_exposures(spark, d):
    out = factors.exposures(daily(spark, d))
    return rounded(out, *out.columns[1:], to=5)


@query("trend_strength", B + f", m AS (SELECT symbol, rn, close, avg(close) OVER {over(250)} AS ma FROM i) SELECT symbol, round(avg(CASE WHEN close > ma THEN 1.0 ELSE 0 END), 6) AS trend_strength FROM m WHERE rn > 250 GROUP BY symbol")
def trend_strength(spark, d):
    return rounded(factors.trend_strength(daily(spark, d)), "trend_strength")


BETA = RETURNS + ", m AS (SELECT ts, avg(ret) AS bench FROM n GROUP BY ts), j AS (SELECT n.symbol, n.ts, n.ret, m.bench FROM n JOIN m USING (ts)), z AS (SELECT symbol, count(*) AS n, regr_slope(ret, bench) AS beta, regr_intercept(ret, bench) AS alpha, regr_r2(ret, bench) AS r2 FROM j GROUP BY symbol)"


@query("factor_beta", B + BETA + " SELECT symbol, n, round(beta, 5) AS beta, round(alpha, 5) AS alpha, round(r2, 5) AS r2, CASE WHEN r2 < 0.15 THEN 'low' WHEN r2 < 0.5 THEN 'medium' ELSE 'high' END AS r2_level FROM z")
def factor_beta(spark, d):
    return rounded(factors.beta(daily(spark, d)), "beta", "alpha", "r2", to=5)


@query(
    "attribution",
    B
    + BETA
    + """, q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM j), s AS (SELECT symbol, sum(ret) AS total, sum(bench) AS bench, count(*) AS cnt FROM q WHERE k <= 63 GROUP BY symbol),
    p AS (SELECT s.symbol, unnest([{'f': 'benchmark', 'c': beta * bench}, {'f': 'alpha', 'c': alpha * cnt}, {'f': 'residual', 'c': total - beta * bench - alpha * cnt}]) AS u FROM s JOIN z USING (symbol))
    SELECT symbol, u.f AS factor, round(u.c, 5) AS contribution, CAST(row_number() OVER (PARTITION BY symbol ORDER BY abs(u.c) DESC, u.f) AS INTEGER) AS rank FROM p""",
)
def attribution(spark, d):
    return rounded(factors.attribution(daily(spark, d)), "contribution", to=5)


@query(
    "residual_momentum",
    B
    + BETA
    + """, q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM j), g AS (SELECT symbol, count(*) AS cnt, product(1 + ret) FILTER (k BETWEEN 22 AND 252) - 1 AS own, product(1 + bench) FILTER (k BETWEEN 22 AND 252) - 1 AS other FROM q GROUP BY symbol)
    SELECT symbol, round(CASE WHEN cnt >= 273 THEN own - beta * other END, 5) AS residual_momentum FROM g JOIN z USING (symbol)""",
)
def residual_momentum(spark, d):
    return rounded(factors.residual_momentum(daily(spark, d)), "residual_momentum", to=5)


@query(
    "two_factor_regression",
    B
    + BETA
    + """, l AS (SELECT *, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM j), c AS (SELECT symbol, avg(ret) AS my, avg(bench) AS ma, avg(before) AS mb, covar_pop(ret, bench) AS ya, covar_pop(ret, before) AS yb, var_pop(bench) AS aa, var_pop(before) AS bb, covar_pop(bench, before) AS ab, var_pop(ret) AS yy FROM l WHERE before IS NOT NULL GROUP BY symbol),
    w AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS wb FROM c)
    SELECT symbol, round(my - wa * ma - wb * mb, 5) AS intercept, round(wa, 5) AS bench, round(wb, 5) AS before, round((wa * ya + wb * yb) / yy, 5) AS r2 FROM w""",
)
def two_factor_regression(spark, d):
    return rounded(factors.solve(factors.peers(daily(spark, d)), "ret", ["bench", "before"]), "intercept", "bench", "before", "r2", to=5)


@query("factor_regression", B + RETURNS + ", l AS (SELECT symbol, ts, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM n) SELECT symbol, round(regr_intercept(ret, x), 5) AS intercept, round(regr_slope(ret, x), 5) AS lagged, round(regr_r2(ret, x), 5) AS r2 FROM l WHERE x IS NOT NULL GROUP BY symbol")
def factor_regression(spark, d):
    rows = factors.returns(daily(spark, d)).withColumn("lagged", F.lag("ret").over(R.ordered()))
    return rounded(factors.solve(rows, "ret", ["lagged"]), "intercept", "lagged", "r2", to=5)


@query("factor_statistics", B + RETURNS + " SELECT symbol, round(avg(ret) * 252, 5) AS mean, round(stddev_samp(ret) * sqrt(252.0), 5) AS vol, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 5) AS positive, round(min(ret), 5) AS worst, round(max(ret), 5) AS best FROM n GROUP BY symbol")
def factor_statistics(spark, d):
    out = factors.returns(daily(spark, d)).groupBy("symbol").agg((F.avg("ret") * 252).alias("mean"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("vol"), F.avg((F.col("ret") > 0).cast("int")).alias("positive"), F.min("ret").alias("worst"), F.max("ret").alias("best"))
    return rounded(out, *out.columns[1:], to=5)


@query("monthly_series", "SELECT l_returnflag AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(avg(l_extendedprice), 4) AS mean, round(last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey), 4) AS latest FROM lineitem GROUP BY 1, 2")
def monthly_series(spark, d):
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    out = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), month.alias("month")).agg(F.avg("l_extendedprice").alias("mean"), F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("latest"))
    return rounded(out, "mean", "latest", to=4)


def valued(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("tie"), (F.col("o_totalprice") - 50000).alias("value"))


VALUED = "WITH v AS (SELECT o_custkey AS key, o_orderdate AS ts, o_orderkey AS tie, o_totalprice - 50000 AS value FROM orders), p AS (SELECT * FROM v WHERE value > 0), y AS (SELECT key, CAST(year(ts) AS INTEGER) AS year, last(value ORDER BY ts, tie) AS value FROM p GROUP BY 1, 2)"


@query("yearly_last_positive", VALUED + " SELECT key, year, round(value, 4) AS value FROM y")
def yearly_last_positive(spark, d):
    return rounded(valuation.yearly_last_positive(valued(spark, d)), "value", to=4)


@query("cagr", VALUED + ", e AS (SELECT key, first(value ORDER BY year) AS a, last(value ORDER BY year) AS b, max(year) - min(year) AS years FROM y GROUP BY key) SELECT key, years, round((pow(b / a, 1.0 / years) - 1) * 100, 4) AS cagr FROM e WHERE years > 0")
def cagr(spark, d):
    return rounded(valuation.growth(valuation.yearly_last_positive(valued(spark, d))), "cagr", to=4)


@query(
    "percentile_zone",
    VALUED
    + """, g AS (SELECT key, last(value ORDER BY ts, tie) AS cur, list(value ORDER BY value) AS vs FROM p GROUP BY key), q AS (SELECT key, cur, len(list_filter(vs, lambda x: x <= cur)) / len(vs) * 100 AS pct, vs[least(len(vs) - 1, CAST(floor(len(vs) * 0.2) AS INTEGER)) + 1] AS p20, vs[least(len(vs) - 1, CAST(floor(len(vs) * 0.8) AS INTEGER)) + 1] AS p80 FROM g)
    SELECT key, round(cur, 4) AS current, round(pct, 4) AS percentile, round(p20, 4) AS p20, round(p80, 4) AS p80, CASE WHEN cur <= p20 THEN 'low' WHEN cur >= p80 THEN 'high' ELSE 'middle' END AS zone FROM q""",
)
def percentile_zone(spark, d):
    return rounded(valuation.percentile_zone(valued(spark, d)), "current", "percentile", "p20", "p80", to=4)


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


LATIN = "regexp_extract_all(lower(text), '[a-z][a-z0-9_+./-]*|[0-9]+(?:\\.[0-9]+)?|[\\x{3400}-\\x{9fff}]+')"


@query(
    "bm25_topk",
    f"""WITH a AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest({LATIN}) AS token FROM benchmark) GROUP BY 1, 2), s AS (SELECT doc_id, 0.85 + 0.15 * least(1, greatest(0, coalesce(quality, 1))) AS own, text, {LATIN} AS ts FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
    n AS (SELECT count(*) AS n, avg(len(ts)) AS avgl FROM s), tf AS (SELECT doc_id, own, text, len, token, count(*) AS tf FROM (SELECT doc_id, own, text, len(ts) AS len, unnest(ts) AS token FROM s) WHERE token IN (SELECT token FROM a) GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT doc_id, own, text, token, ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgl)) AS w FROM tf JOIN df USING (token), n),
    c AS (SELECT query_id, doc_id, text, round(sum(w * times) * own, 9) AS score FROM w JOIN a USING (token) GROUP BY query_id, doc_id, text, own), u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, doc_id) = 1),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM u) SELECT query_id, doc_id, rank, round(score, 4) AS score FROM k WHERE rank <= 10""",
)
def bm25_topk(spark, d):
    quality = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weights = quality.withColumn("weight", retrieval.rank_weight(F.lit("knowledge"), F.lit(False), F.col("quality")))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rounded(retrieval.bm25(table(spark, d, "documents"), asked, weights=weights), "score", to=4)


#: A small fixed configuration of knowledge items and terms for the activation and glossary queries.
ITEMS = [
    {"item_id": 1, "weight": 0.9, "triggers": [("the river", 0.4), ("with", 0.5), ("the", 0.3)], "negatives": [("idiot", 1.0)]},
    {"item_id": 2, "weight": 0.7, "triggers": [("und der", 1.0), ("der", 0.3)], "negatives": [("token", 0.5)], "features": {"freshness": 0.9}},
    {"item_id": 3, "weight": 0.8, "triggers": [("market", 0.6), ("dans", 0.8)], "negatives": [("mit", 1.0)], "features": {"sourceReliability": 1.0}},
    {"item_id": 4, "weight": 0.5, "triggers": [("para", 1.2), ("que", 0.4)]},
]
GLOSSARY = [("the", ["le"]), ("of the", []), ("and", ["und", "et"]), ("token", ["password"]), ("para", []), ("e-mail", ["mail"])]


def stands(column: str, phrase: str, word: str = "A-Za-z0-9") -> str:
    return f"regexp_matches({column}, '(^|[^{word}]){phrase}([^{word}]|$)')"


def activation_sql(profile: str) -> str:
    plural = {"river": "river(s|es)?", "idiot": "idiot(s|es)?", "token": "token(s|es)?", "market": "market(s|es)?"}
    pattern = lambda phrase: "[ -]+".join(plural.get(w, w) for w in phrase.split(" "))
    total = lambda phrases: " + ".join(f"CASE WHEN {stands('t', pattern(p), 'a-z0-9_')} THEN {w} ELSE 0 END" for p, w in phrases) or "0"
    rows = " UNION ALL ".join(f"SELECT text_id, {i['item_id']} AS item_id, {i['weight']} AS weight, {total(i['triggers'])} AS up, {total(i.get('negatives', []))} AS down, {retrieval.multiplier(i, profile)!r} AS factor FROM d" for i in ITEMS)
    return f"""WITH d AS (SELECT doc_id AS text_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM documents), h AS ({rows}), s AS (SELECT *, round(least(1.0, greatest(0.0, weight * factor * (1 - exp(-up)) - 0.25 * down)), 4) AS score FROM h WHERE up > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, weight DESC, item_id) AS rank FROM s WHERE score >= 0.2) SELECT text_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5"""


def activation_query(name: str, profile: str) -> None:
    @query(name, activation_sql(profile))
    def run(spark, d):
        return retrieval.activate(table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), ITEMS, profile=profile)


activation_query("trigger_activation", "balanced")
activation_query("trigger_activation_current", "current")


@query(
    "glossary_terms",
    "WITH d AS (SELECT doc_id AS text_id, lower(text) AS t FROM documents), f AS (SELECT text_id, list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(stands('t', p, 'a-z0-9') for p in (term, *aliases))} THEN '{term}' END" for term, aliases in GLOSSARY) + "], lambda x: x IS NOT NULL)[1:8] AS terms FROM d) SELECT text_id, unnest(terms) AS term, CAST(generate_subscripts(terms, 1) AS INTEGER) AS place FROM f",
)
def glossary_terms(spark, d):
    return retrieval.glossary(table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), GLOSSARY)


@query("near_dup_atoms", r"SELECT sha256(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS key, min(doc_id) AS atom_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS origins FROM documents GROUP BY 1")
def near_dup_atoms(spark, d):
    return retrieval.merge_atoms(table(spark, d, "documents").select(F.col("doc_id").alias("atom_id"), "text", F.col("source").alias("origin"))).withColumn("origins", F.array_join("origins", ","))


@query("text_quality", r"SELECT doc_id, round(greatest(0.0, length(regexp_replace(text, '[^\p{L}\p{N}\p{P}\s]', '', 'g')) / length(text) - 0.01 * length(regexp_replace(text, '[^�]', '', 'g'))), 6) AS quality FROM documents")
def text_quality(spark, d):
    return rounded(table(spark, d, "documents").select("doc_id", retrieval.text_quality(F.col("text")).alias("quality")), "quality")


@query("html_strip", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\r\n]+", " ")).alias("text"))


@query("case_similarity", f"WITH q AS (SELECT item_id, list_distinct({TOKENS}) AS a FROM benchmark), x AS (SELECT a.item_id AS left_id, b.item_id AS right_id, len(list_intersect(a.a, b.a)) / len(list_distinct(list_concat(a.a, b.a))) AS jaccard FROM q a JOIN q b ON a.item_id < b.item_id), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY left_id ORDER BY jaccard DESC, right_id) AS INTEGER) AS rank FROM x) SELECT left_id, right_id, round(jaccard, 6) AS jaccard, rank FROM k WHERE rank <= 3 AND jaccard > 0")
def case_similarity(spark, d):
    """Shared words are counted by a join on the word, so only pairs that share one are made."""
    words = table(spark, d, "benchmark").select("item_id", F.array_distinct(retrieval.tokens(F.col("text"))).alias("ws")).select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    a, b = words.select(F.col("item_id").alias("left_id"), F.col("n").alias("ln"), "w"), words.select(F.col("item_id").alias("right_id"), F.col("n").alias("rn"), "w")
    shared = a.join(b, "w").where("left_id < right_id").groupBy("left_id", "right_id", "ln", "rn").agg(F.count(F.lit(1)).alias("both"))
    scored = shared.select("left_id", "right_id", (F.col("both") / (F.col("ln") + F.col("rn") - F.col("both"))).alias("jaccard"))
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.col("jaccard").desc(), "right_id"))
    return rounded(scored.withColumn("rank", rank).where("rank <= 3"), "jaccard")


@query("grouping_rollup", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ROLLUP (event_type, CAST(CAST(ts AS DATE) AS VARCHAR))")
def grouping_rollup(spark, d):
    rows = table(spark, d, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), "value")
    return rounded(rows.rollup("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", to=3)


@query(
    "activity_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 30 MINUTE AS last_ts, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
)
def activity_sessions(spark, d):
    out = streaming.sessions(table(spark, d, "events"))
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")}), "total", to=4)


@query("chan_structure")
def chan_structure(spark, d):
    return rounded(chan.structure(daily(spark, d)), "low", "high")
