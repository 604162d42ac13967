"""Inputs on which a query was found to differ from its SQL, or to take steps that grow faster than its input."""

from __future__ import annotations

import time

import duckdb
from pyspark.sql import functions as F

from tickloom.operators import judgment, records, retrieval
from tickloom.plans import judgment as plans  # noqa: F401  registers its queries
from tickloom.plans import records as record_plans  # noqa: F401
from tickloom.plans import scalars  # noqa: F401
from tickloom.plans.registry import ORACLES, QUERIES


def both(spark, folder, name: str, *tables: str) -> tuple[list[tuple], list[tuple]]:
    """The sorted rows of a query and those of its SQL, columns in the order of the SQL."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    wanted = con.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    key = lambda row: tuple((x is None, x if x is not None else 0) for x in row)
    found = [tuple(r) for r in QUERIES[name](spark, str(folder)).select(*columns).collect()]
    return sorted(found, key=key), sorted(wanted.fetchall(), key=key)


def test_intercepts_halfway_between_two_places(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/orders.parquet' WHERE o_custkey IN (6912, 11898)) TO '{tmp_path}/orders.parquet'")
    found, wanted = both(spark, tmp_path, "fit_scalars", "orders")
    assert len(wanted) == 2 and found == wanted


def test_fits_halfway_of_minus_zero_or_without_a_price(spark, tmp_path):
    prices = {
        1: [414432.13, 219314.68, 384903.21, 93520.86, 135145.93, 84522.59, 158746.45],  # the intercept is 56673.15 to the last bit but one
        2: [80254.11, 73844.1, 324438.76, 202796.49, 137955.29, 178363.2],  # and 15735.95 here
        3: [7.0, None, 21.0, 35.0],
        4: [None, 1400.0, 2800.0, 700.0, None],
        5: [None, None],
        6: [None, 70.0],
        7: [700.35, 700.28, 700.21, 700.14, 700.07, 700.0],  # small and negative
        8: [0.0, 700.0, 1400.0],
        9: [700.0, 0.0, 2100.0],
        10: [0.0, 0.0],
        11: [700.0, 350.0, 0.0, 0.0],
    }
    rows = ", ".join(f"({k}, {i}, {'NULL' if y is None else y})" for k, ys in prices.items() for i, y in enumerate(ys))
    values = f"SELECT CAST(k AS BIGINT) AS o_custkey, CAST(i AS BIGINT) AS o_orderkey, TIMESTAMP '1995-01-01' AS o_orderdate, CAST(y AS DOUBLE) AS o_totalprice FROM (VALUES {rows}) v(k, i, y)"
    duckdb.execute(f"COPY ({values} UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM '/root/testdata/sf0.1/orders.parquet' WHERE o_custkey IN (6609, 9997)) TO '{tmp_path}/orders.parquet'")
    found, wanted = both(spark, tmp_path, "fit_scalars", "orders")
    assert len(wanted) == 13 and list(map(repr, found)) == list(map(repr, wanted))  # 0.0 and -0.0 have other texts


def test_votes_without_weight(spark, tmp_path):
    values = "(1, 'A', 0.1, NULL), (1, 'R', 0.1, NULL), (2, 'A', 0.1, 0), (3, 'A', 0.1, NULL), (3, 'R', 0.05, 5), (4, 'N', 0.1, 1), (4, 'A', 0.1, -1), (5, 'N', NULL, 3), (6, NULL, 0.07, 3), (6, 'A', 0.04, 50), (7, 'R', 0.1, 'nan'), (7, 'A', 0.1, 9), (NULL, 'R', 0.06, 9)"
    duckdb.execute(f"COPY (SELECT CAST(k AS BIGINT) AS l_suppkey, f AS l_returnflag, CAST(d AS DOUBLE) AS l_discount, CAST(q AS DOUBLE) AS l_quantity FROM (VALUES {values.replace("'nan'", "CAST('nan' AS DOUBLE)")}) v(k, f, d, q)) TO '{tmp_path}/lineitem.parquet'")
    found, wanted = both(spark, tmp_path, "case_consensus", "lineitem")
    assert len(wanted) == 7 and list(map(repr, found)) == list(map(repr, wanted))


def test_equal_votes_added_in_another_order(spark):
    votes = [("bullish", 0.7, 0.1), ("bullish", 0.7, 0.2), ("bullish", 0.7, 0.3), ("neutral", 0.7, 0.6)]  # 0.42000000000000004 and 0.42
    rows = [(key, other if key else direction, s, q) for key in (0, 1) for direction, s, q in votes for other in [{"bullish": "neutral", "neutral": "bullish"}[direction]]]
    found = records.consensus(spark.createDataFrame(rows, "key long, direction string, similarity double, quality double"))
    assert sorted((r.key, r.direction) for r in found.collect()) == [(0, "neutral"), (1, "neutral")]


def test_a_share_halfway_added_in_another_order(spark, tmp_path):
    votes = [("N", 9, 11), ("N", 7, 45), ("R", 8, 1), ("A", 10, 7), ("A", 10, 9), ("R", 6, 48), ("A", 10, 41)]  # 570 of 1280 is 0.4453125
    rows = ", ".join(f"({key}, '{f}', {d / 100}, {q})" for key, turned in ((1, votes), (2, votes[::-1])) for f, d, q in turned)
    duckdb.execute(f"COPY (SELECT CAST(k AS BIGINT) AS l_suppkey, f AS l_returnflag, CAST(d AS DOUBLE) AS l_discount, CAST(q AS DOUBLE) AS l_quantity FROM (VALUES {rows}) v(k, f, d, q)) TO '{tmp_path}/lineitem.parquet'")
    found = QUERIES["case_consensus"](spark, str(tmp_path)).collect()
    assert sorted((r.key, r.direction, r.strength) for r in found) == [(1, "bullish", 0.445313), (2, "bullish", 0.445313)]


def test_ranges_that_end_before_they_start_or_have_no_place(spark, tmp_path):
    ids = ["-17", "-17", "-34", "4", "5004", "NULL", "89", "-89"]
    duckdb.execute(f"COPY (SELECT CAST(7 AS BIGINT) AS user_id, CAST(unnest([{', '.join(ids)}]) AS BIGINT) AS event_id) TO '{tmp_path}/events.parquet'")
    found, wanted = both(spark, tmp_path, "interval_merge", "events")
    assert found == wanted


def test_equal_queries_and_equal_cases_are_compared_once(spark):
    same = spark.range(20_000).select(F.col("id"), F.array(F.lit("p1"), F.lit("p2")).alias("patterns"), F.array(F.lit("t1")).alias("tags"), F.lit("up").alias("trend"), F.lit("high").alias("place"))
    cases = same.withColumnRenamed("id", "case_id").withColumn("quality", F.lit(0.9))
    began = time.monotonic()
    found = judgment.case_scores(same.withColumnRenamed("id", "query_id"), cases).groupBy("case_id", "rank", "similarity").count().collect()
    assert sorted(map(tuple, found)) == [(i, i + 1, 0.99, 20_000) for i in range(8)]
    assert time.monotonic() - began < 90  # 400 million pairs take longer


def test_pairs_of_conflicts_are_joined_once(spark):
    found = QUERIES["signal_conflicts"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_pairs_of_conflicts_are_rounded_without_decimals_and_shuffled_as_signals(spark):
    found = QUERIES["signal_conflicts"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "first_block" not in plan  # which follows from start


def test_conflicts_of_odd_orders(spark, tmp_path):
    rows = "(0, 400), (400, 400), (4, 400), (1, 400), (31, 1000), (61, 1000), (NULL, 400), (7, NULL), (900, 36), (1801, 636), (1801, 636), (1804, 1236)"
    duckdb.execute(f"COPY (SELECT CAST(k AS BIGINT) AS o_orderkey, CAST(c AS BIGINT) AS o_custkey FROM (VALUES {rows}) v(k, c) UNION ALL SELECT CAST(range * 9973 AS BIGINT), CAST(range // 3 % 6 * 100 AS BIGINT) FROM range(700)) TO '{tmp_path}/orders.parquet'")
    found, wanted = both(spark, tmp_path, "signal_conflicts", "orders")
    assert len(wanted) == 438 and list(map(repr, found)) == list(map(repr, wanted))


def test_terms_that_all_share_make_no_row_a_pair(spark):
    words = " ".join(f"word{i}" for i in range(60))
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(words + " own"), (F.col("id") % 9_000).cast("string")).alias("text"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit(words + " own"), F.col("id").cast("string")).alias("text"))
    began = time.monotonic()
    found = retrieval.bm25(docs, asked, k=3).select("query_id", "doc_id", "rank").collect()
    assert sorted((q, d) for q, d, r in found if r == 1) == [(i, i) for i in range(300)]
    assert [d for _, d, _ in sorted((q, d, r) for q, d, r in found if q == 5)] == [0, 1, 5]  # 9,005 has the text of 5
    assert time.monotonic() - began < 60  # 180 million rows of a term, a document and a query take longer


def test_ranked_copies_and_missing_texts(spark, tmp_path):
    con = duckdb.connect()
    texts = "NULL, '', 'the river', 'the river runs', 'a river a river', '...', 'the river'"
    con.execute(f"CREATE TABLE t AS SELECT CAST(range * 7 % 101 AS BIGINT) AS doc_id, [{texts}][CAST(range % 7 AS INTEGER) + 1] AS text FROM range(200)")
    con.execute(f"COPY (SELECT * FROM t UNION ALL SELECT 3, 'the river' FROM range(4) UNION ALL SELECT NULL, 'a stream') TO '{tmp_path}/documents.parquet'")
    con.execute(f"COPY (SELECT doc_id, CAST(doc_id % 5 AS DOUBLE) / 4 AS quality FROM t WHERE doc_id % 3 > 0) TO '{tmp_path}/labels.parquet'")
    con.execute(f"COPY (SELECT CAST(range AS BIGINT) AS item_id, ['The river, the', 'runs', 'a stream', '', NULL, 'nothing else'][range + 1] AS text FROM range(6)) TO '{tmp_path}/benchmark.parquet'")
    found, wanted = both(spark, tmp_path, "bm25_topk", "documents", "labels", "benchmark")
    assert len(wanted) > 5 and found == wanted
