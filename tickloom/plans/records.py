"""Queries over keyed records and over stages of a series; importing the module registers them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import half_away
from ..operators import records, stages
from .registry import B, RETURNS, daily, over, query, rounded, table

#: Texts that stand for what people type as a symbol, made from a key in both dialects.
TYPED = """CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN concat('SH', lpad(CAST(p_partkey AS STRING), 6, '0')) WHEN 1 THEN lpad(CAST(p_partkey AS STRING), 6, '6') WHEN 2 THEN lpad(CAST(p_partkey AS STRING), 6, '0')
    WHEN 3 THEN lpad(CAST(p_partkey AS STRING), 5, '0') WHEN 4 THEN concat(' hk ', lpad(CAST(p_partkey AS STRING), 5, '0')) WHEN 5 THEN concat('us^', CAST(p_partkey AS STRING)) WHEN 6 THEN 'Com Gold' WHEN 7 THEN concat('Abc.', CAST(p_partkey AS STRING)) ELSE concat('?', CAST(p_partkey AS STRING)) END"""


@query(
    "symbol_mapping",
    rf"""WITH r AS (SELECT p_partkey, lower(regexp_replace({TYPED}, '\s', '', 'g')) AS raw FROM part),
    s AS (SELECT p_partkey, CASE WHEN regexp_full_match(raw, '(sh|sz|bj)[0-9]{{6}}|hk[0-9]{{5}}|us[a-z0-9^=._-]{{1,24}}|hkhsi|fx[a-z]{{6}}') OR raw IN ('comgold', 'comoil', 'comsilver') THEN raw WHEN regexp_full_match(raw, '[5689][0-9]{{5}}') THEN 'sh' || raw
    WHEN regexp_full_match(raw, '[0-9]{{6}}') THEN 'sz' || raw WHEN regexp_full_match(raw, '[0-9]{{5}}') THEN 'hk' || raw WHEN regexp_full_match(raw, '[a-z][a-z0-9._-]{{0,10}}') THEN 'us' || raw END AS symbol FROM r)
    SELECT p_partkey, symbol, CASE WHEN regexp_full_match(symbol, 'sh[0-9]+') THEN '1.' || symbol[3:] WHEN regexp_full_match(symbol, '(sz|bj)[0-9]+') THEN '0.' || symbol[3:] WHEN regexp_full_match(symbol, 'hk[0-9]+') THEN '116.' || symbol[3:]
    WHEN regexp_full_match(symbol, 'us[a-z][a-z0-9.-]{{0,10}}') THEN '105.' || upper(symbol[3:]) END AS security_id, CASE symbol[1:2] WHEN 'hk' THEN 'hkhsi' WHEN 'us' THEN 'usspy' ELSE 'sh000300' END AS benchmark FROM s""",
)
def symbol_mapping(spark, d):
    rows = table(spark, d, "part").select("p_partkey", records.normal_symbol(F.expr(TYPED)).alias("symbol"))
    return rows.select("p_partkey", "symbol", records.security_id(F.col("symbol")).alias("security_id"), records.benchmark_of(F.col("symbol")).alias("benchmark"))


@query("source_router", "SELECT l_partkey, source, count(*) AS n, round(sum(l_quantity), 4) AS total FROM (SELECT l_partkey, CAST(l_suppkey % 3 AS INTEGER) AS source, l_quantity, min(l_suppkey % 3) OVER (PARTITION BY l_partkey) AS best FROM lineitem) WHERE source = best GROUP BY 1, 2")
def source_router(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", (F.col("l_suppkey") % 3).cast("int").alias("source"), "l_quantity")
    offered = rows.groupBy("l_partkey", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))
    return rounded(records.first_source(offered, "l_partkey", "source"), "total", to=4)


AS_OF = "1997-06-30"


@query(
    "latest_disclosed",
    f"""WITH r AS (SELECT o_custkey AS key, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS stat_date, CAST(o_orderdate AS DATE) + 120 AS pub_date, o_totalprice AS value FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stat_date DESC, pub_date DESC, value DESC) AS rn FROM r WHERE pub_date <= DATE '{AS_OF}' AND stat_date > DATE '{AS_OF}' - INTERVAL 18 MONTH) SELECT key, stat_date, pub_date, round(value, 4) AS value FROM k WHERE rn = 1""",
)
def latest_disclosed(spark, d):
    quarter_end = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), quarter_end.alias("stat_date"), F.date_add(F.to_date("o_orderdate"), 120).alias("pub_date"), F.col("o_totalprice").alias("value"))
    return rounded(records.latest_disclosed(rows, AS_OF), "value", to=4)


@query("repeated_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_ids(spark, d):
    return records.repeated(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("missing_ids", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def missing_ids(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query(
    "page_runs",
    """WITH p AS (SELECT DISTINCT l_suppkey AS source, l_partkey % 300 AS page FROM lineitem), i AS (SELECT *, page - row_number() OVER (PARTITION BY source ORDER BY page) AS island FROM p),
    c AS (SELECT *, (page - min(page) OVER (PARTITION BY source, island)) // 4 AS part FROM i) SELECT source, min(page) AS first_page, max(page) AS last_page, count(*) AS n FROM c GROUP BY source, island, part""",
)
def page_runs(spark, d):
    return records.page_runs(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 300).alias("page")), "source", "page")


RULES = {
    "large_urgent": {"o_totalprice": {"gte": 200000.0}, "o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]}},
    "open_or_small": {"o_orderstatus": {"any_of": [{"eq": "O"}, {"eq": "P"}]}, "o_totalprice": {"lt": 50000.0}},
    "not_low": {"o_orderpriority": {"ne": "5-LOW", "exists": True}, "o_totalprice": {"gt": 400000.0, "lte": 1000000.0}},
    "has_medium": {"o_orderpriority": {"contains": "MEDIUM"}, "o_orderstatus": "F"},
}


@query(
    "rule_conditions",
    """SELECT o_orderkey, 'large_urgent' AS rule_id FROM orders WHERE o_totalprice >= 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') UNION ALL SELECT o_orderkey, 'open_or_small' FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice < 50000
    UNION ALL SELECT o_orderkey, 'not_low' FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice > 400000 AND o_totalprice <= 1000000 UNION ALL SELECT o_orderkey, 'has_medium' FROM orders WHERE contains(o_orderpriority, 'MEDIUM') AND o_orderstatus = 'F'""",
)
def rule_conditions(spark, d):
    return records.matched_rules(table(spark, d, "orders"), RULES).select("o_orderkey", "rule_id")


@query(
    "feedback_statistics",
    """WITH f AS (SELECT unnest([user_id % 20, user_id % 7 + 100]) AS rule_id, event_id % 5 < 3 AS accepted, event_type AS decision FROM events), g AS (SELECT rule_id, decision, count(*) AS n, sum(CAST(accepted AS INTEGER)) AS yes FROM f GROUP BY 1, 2)
    SELECT rule_id, CAST(sum(n) AS BIGINT) AS n, round(sum(yes) / sum(n), 6) AS acceptance_rate, array_to_string(list_sort(list(decision || '=' || CAST(n AS VARCHAR))), ',') AS decisions, sum(n) >= 10 AND sum(yes) / sum(n) < 0.6 AS review_needed FROM g GROUP BY rule_id""",
)
def feedback_statistics(spark, d):
    rows = table(spark, d, "events").select(F.array(F.col("user_id") % 20, F.col("user_id") % 7 + 100).alias("rule_ids"), (F.col("event_id") % 5 < 3).alias("accepted"), F.col("event_type").alias("decision"))
    return rounded(records.feedback_statistics(rows), "acceptance_rate")


@query(
    "case_consensus",
    """WITH m AS (SELECT l_suppkey AS key, CASE l_returnflag WHEN 'A' THEN 'bullish' WHEN 'R' THEN 'bearish' ELSE 'neutral' END AS direction, l_discount * 10 AS similarity, l_quantity / 50 AS quality FROM lineitem),
    w AS (SELECT key, direction, sum(similarity * quality) AS w, count(*) AS n FROM m WHERE similarity >= 0.45 GROUP BY 1, 2) SELECT key, arg_max(direction, w) AS direction, round(max(w) / sum(w), 6) AS strength, CAST(sum(n) AS BIGINT) AS supporting FROM w GROUP BY key""",
)
def case_consensus(spark, d):
    direction = F.when(F.col("l_returnflag") == "A", "bullish").when(F.col("l_returnflag") == "R", "bearish").otherwise("neutral")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), direction.alias("direction"), (F.col("l_discount") * 10).alias("similarity"), (F.col("l_quantity") / 50).alias("quality"))
    share = F.when(F.col("total") == 0, F.col("best") * float("inf")).otherwise(F.try_divide("best", "total"))  # of no weight what SQL's doubles give, NaN
    steady = F.round(share, 14)  # last bits depend on the order of adding, and would decide a share halfway between two places
    return records.weighed(rows).select("key", "direction", half_away(steady, 6).alias("strength"), "supporting")


@query(
    "major_parts",
    """WITH p AS (SELECT o_custkey AS key, o_orderpriority AS name, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2), s AS (SELECT *, value / sum(value) OVER (PARTITION BY key) AS share, row_number() OVER w AS rank FROM p WINDOW w AS (PARTITION BY key ORDER BY value DESC, name)),
    b AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY key ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT key, name, round(value, 3) AS value, round(share, 6) AS share, CAST(rank AS INTEGER) AS rank FROM b WHERE rank <= 3 AND before < 0.5""",
)
def major_parts(spark, d):
    parts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name")).agg(F.sum("o_totalprice").alias("value"))
    return rounded(rounded(records.major_parts(parts, "key", "name", "value"), "value", to=3), "share")


@query(
    "linked_items",
    """WITH h AS (SELECT c_nationkey AS query_id, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), t AS (SELECT * FROM h WHERE rank <= 5),
    l AS (SELECT c_custkey AS id, 0 AS position, (c_custkey * 7 + 1) % 150 AS "to" FROM customer UNION ALL SELECT c_custkey, 1, (c_custkey + 13) % 150 FROM customer), s AS (SELECT query_id, "to", min(rank * 10 + position) AS first FROM t JOIN l USING (id) GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = s.query_id AND t.id = s."to")) SELECT query_id, "to", CAST(place AS INTEGER) AS place FROM k WHERE place <= 5""",
)
def linked_items(spark, d):
    people = table(spark, d, "customer")
    top = Window.partitionBy("query_id").orderBy(F.col("c_acctbal").desc(), "id")
    hits = people.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"), "c_acctbal").withColumn("rank", F.row_number().over(top)).where("rank <= 5").drop("c_acctbal")
    links = people.select(F.col("c_custkey").alias("id"), F.posexplode(F.array((F.col("c_custkey") * 7 + 1) % 150, (F.col("c_custkey") + 13) % 150)).alias("position", "to"))
    return records.linked(hits, links)


@query(
    "three_stages",
    B
    + """, s AS (SELECT *, ntile(3) OVER (PARTITION BY symbol ORDER BY ts) AS stage FROM b), c AS (SELECT symbol, CAST(stage AS INTEGER) AS stage, min(ts) AS first_ts, max(ts) AS last_ts, last(close ORDER BY ts) / first(close ORDER BY ts) - 1 AS change, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT symbol, stage, first_ts, last_ts, round(change, 6) AS change, n, CASE WHEN change > 0.03 THEN 'up' WHEN change < -0.03 THEN 'down' ELSE 'flat' END AS state FROM c WHERE n >= 2""",
)
def three_stages(spark, d):
    return rounded(stages.three_stages(daily(spark, d)), "change")


@query("body_class", B + f", x AS (SELECT symbol, ts, abs(close - open) AS b FROM b), y AS (SELECT symbol, ts, b / CASE WHEN count(b) OVER {over(20)} >= 5 THEN nullif(avg(b) OVER {over(20)}, 0) END AS ratio FROM x) SELECT symbol, ts, CASE WHEN ratio <= 0.08 THEN 'doji' WHEN ratio <= 0.8 THEN 'small' WHEN ratio <= 2 THEN 'medium' ELSE 'large' END AS class FROM y WHERE ratio IS NOT NULL")
def body_class(spark, d):
    return stages.body_class(daily(spark, d))


@query(
    "big_candle_quota",
    B
    + f""", x AS (SELECT symbol, ts, open, close, high - low AS r, abs(close - open) AS b FROM b), y AS (SELECT *, CASE WHEN count(b) OVER {over(20)} >= 2 THEN avg(b) OVER {over(20)} END AS mean, count(*) OVER (PARTITION BY symbol) AS n FROM x),
    f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY b DESC, ts) AS rank FROM y WHERE b > mean * 2 AND 1 - b / nullif(r, 0) < 0.15 AND b / nullif(r, 0) > 0.85),
    q AS (SELECT *, greatest(1, round_even(n * CASE WHEN n <= 50 THEN 0.10::DOUBLE WHEN n <= 120 THEN 0.10::DOUBLE - (n - 50) * (0.02::DOUBLE / 70) ELSE greatest(0.06::DOUBLE, 0.08::DOUBLE - (n - 120) * (0.02::DOUBLE / 80)) END, 0)) AS quota FROM f)
    SELECT symbol, ts, CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END AS kind, CAST(rank AS INTEGER) AS rank FROM q WHERE rank <= quota""",
)
def big_candle_quota(spark, d):
    return stages.big_candles(daily(spark, d))


@query("held_lows", B + "SELECT symbol, ts, CASE WHEN count(close) OVER w = 5 THEN min(close) OVER w >= low END AS held FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)")
def held_lows(spark, d):
    return stages.held_lows(daily(spark, d))


@query("volume_divergence", B + ", c AS (SELECT symbol, close / lag(close) OVER w - 1 AS p, volume / lag(volume) OVER w - 1 AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, round(corr(p, v), 6) AS divergence FROM c WHERE k < 60 AND p IS NOT NULL AND v IS NOT NULL GROUP BY symbol HAVING count(*) >= 30")
def volume_divergence(spark, d):
    return rounded(stages.volume_divergence(daily(spark, d)), "divergence")


@query("return_matrix", B + RETURNS + " SELECT a.ts, round(a.ret, 6) AS ret_a, round(n.ret, 6) AS ret_n, round(r.ret, 6) AS ret_r FROM n a JOIN n USING (ts) JOIN n r USING (ts) WHERE a.symbol = 'A' AND n.symbol = 'N' AND r.symbol = 'R'")
def return_matrix(spark, d):
    return rounded(stages.return_matrix(daily(spark, d), ["A", "N", "R"]), "ret_a", "ret_n", "ret_r")


@query(
    "weekly_average_by_day",
    B
    + f""", d AS (SELECT symbol, ts, rn, close, CAST(ts + CAST((12 - isodow(ts)) % 7 AS INTEGER) AS DATE) AS week FROM i), k AS (SELECT symbol, week AS ts, max(rn) AS place, last(close ORDER BY ts) AS close FROM d GROUP BY symbol, week),
    m AS (SELECT symbol, place, CASE WHEN count(close) OVER {over(12)} = 12 THEN avg(close) OVER {over(12)} END AS value FROM k), v AS (SELECT * FROM m WHERE value IS NOT NULL),
    a AS (SELECT d.symbol, d.ts, d.rn, v.place, v.value FROM d ASOF LEFT JOIN v ON d.symbol = v.symbol AND d.rn >= v.place), z AS (SELECT a.*, v.place AS next_place, v.value AS next_value FROM a ASOF LEFT JOIN v ON a.symbol = v.symbol AND a.rn <= v.place)
    SELECT symbol, ts, round(coalesce(value + (next_value - value) * CASE WHEN next_place > place THEN (rn - place) / (next_place - place) ELSE 0 END, value, next_value), 6) AS center FROM z""",
)
def weekly_average_by_day(spark, d):
    return rounded(stages.weekly_average_by_day(daily(spark, d)), "center")
