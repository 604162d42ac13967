"""Streams that are started: late files, and the same bars and sessions as in batch."""

from pyspark.sql import functions as F

from tickloom.streaming import bars as streaming

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp, value double"


def fed(spark, tmp_path, files, query, mode="append", name="bars"):
    """The stream's table after each file has been a batch of its own."""
    path, like = str(tmp_path / "in"), spark.createDataFrame([], SCHEMA)
    for n, rows in enumerate(files):
        at = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
        at.coalesce(1).write.mode("append").parquet(path)
        run = query(streaming.read_events(spark, path, like)).writeStream.format("parquet").outputMode(mode)
        started = run.option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        try:
            assert started.awaitTermination(120)
        finally:
            started.stop()
        assert n >= 0
    return spark.read.parquet(str(tmp_path / "out"))


DAY = "2024-01-01 "
FIRST = [(1, 7, "buy", DAY + "10:05:00", 3.0), (2, 7, "buy", DAY + "10:40:00", 5.0), (3, 8, "sell", DAY + "10:10:00", 2.0)]
LATE = [(4, 7, "buy", DAY + "10:01:00", 9.0), (5, 8, "sell", DAY + "11:30:00", 4.0)]  # an hour late, within the two that are waited for
LATER = [(6, 9, "buy", DAY + "15:00:00", 1.0)]
GONE = [(7, 9, "buy", DAY + "10:30:00", 99.0), (8, 9, "buy", DAY + "20:00:00", 1.0)]  # the first is past the watermark
END = [(9, 9, "buy", "2024-01-02 10:00:00", 1.0)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_bars_merge_late_ticks_and_drop_those_past_the_watermark(spark, tmp_path):
    got = fed(spark, tmp_path, [FIRST, LATE, LATER, GONE, END], streaming.hourly_bars)
    kept = [r for r in FIRST + LATE + LATER + GONE if r[0] != 7]
    table = spark.createDataFrame(kept, "event_id long, user_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert rows_of(got) == rows_of(streaming.hourly_bars(table))
    assert [tuple(r)[2:] for r in got.where("symbol = 'buy' and hour(ts) = 10").collect()] == [(9.0, 9.0, 3.0, 5.0, 3)]


def test_sessions_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    got = fed(spark, tmp_path, [FIRST, LATE, LATER, END], streaming.sessions)
    table = spark.createDataFrame(FIRST + LATE + LATER, "event_id long, user_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert rows_of(got) == rows_of(streaming.sessions(table))
