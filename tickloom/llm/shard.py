"""Sharding with equal row counts by a two-pass external shuffle.

Pass 1 scatters rows uniformly into buckets by a seeded hash of doc_id and text; a
bucket holds about ``bucket_bytes`` bytes of text, so the number of buckets grows
with the table and the memory of a task does not. Pass 2 gathers one bucket at a
time, puts it into a fixed order, does a Fisher-Yates shuffle on it (Spark's
``shuffle`` function with a seed) and writes it. The buckets one after the other are
the shuffled table, and a shard is a run of it: with n rows and k shards the first
n mod k shards have one row more than the others (law ``rows``). So a bucket goes to
one shard, or two where one ends, and is written where it was shuffled.

Rows that are equal in doc_id and text share a bucket; where that makes one more than
``OVERFULL`` times as large as it should be, its rows are numbered and dealt out by
their numbers to as many buckets as are needed. Such rows can't be told apart, but
which of them goes where may differ with the partitioning of the input.

Defined results: a null text is written as an empty one, with size 1 and the checksum
of no bytes; an empty table gives no rows; rows that repeat each other get slots of
their own; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, numbered, text_or_empty

OVERFULL = 4
BROADCAST_BUCKETS = 500_000


def scattered(n_buckets: int, *columns: Column) -> Column:
    """A bucket from 0 to n_buckets - 1 by a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(n_buckets)).cast("long")


def running_before(sizes: DataFrame, key: str, value: str, block: int = 4096) -> DataFrame:
    """``sizes`` (one row a key) with ``first``, the sum of ``value`` over smaller keys, by blocks of keys."""
    blocks = sizes.withColumn("block", F.floor(F.col(key) / block))
    ahead = blocks.groupBy("block").agg(F.sum(value).alias("held")).select("block", (F.sum("held").over(Window.orderBy("block")) - F.col("held")).alias("ahead"))
    inside = F.sum(value).over(Window.partitionBy("block").orderBy(key)) - F.col(value)
    return blocks.withColumn("inside", inside).join(ahead, "block").withColumn("first", F.col("ahead") + F.col("inside")).drop("block", "inside", "ahead")


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, seed: int = 20_240_117, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Write ``docs`` as Parquet, one folder a shard, each file in the order of its slots; doc_id, text, shard and slot as read back."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    size = F.octet_length("text").cast("long") + 1
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    n_buckets = max(1, ceil(total["bytes"] / bucket_bytes))
    rows = rows.withColumn("bucket", scattered(n_buckets, F.lit(seed), F.col("doc_id"), F.col("text")))
    sizes = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")))
    overfull = sizes.where(F.col("bytes") > OVERFULL * bucket_bytes).select("bucket", F.ceil(F.col("bytes") / bucket_bytes).cast("int").alias("parts"))
    keys = ["bucket"]  # a constant among them would cost a shuffle
    if not overfull.isEmpty():
        keys = ["bucket", "part"]
        rows, key = numbered(rows)
        rows = rows.join(overfull, "bucket", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(F.lit(seed), key), F.col("parts")).cast("int"), F.lit(0))).drop(key, "parts")
        sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
        n_buckets += overfull.agg(F.sum("parts")).first()[0]

    order = F.col("bucket") * (1 << 20) + (F.col("part") if "part" in keys else F.lit(0))
    first = running_before(sizes.select(*keys, "n", order.alias("order")), "order", "n", 1 << 32).select(*keys, "first")
    gathered = rows.repartition(n_buckets, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("rows"))
    shuffled = gathered.sortWithinPartitions(*keys).select(*keys, F.shuffle("rows", F.lit(seed)).alias("rows"))
    # few rows of three numbers go to all tasks; many are dealt out as the buckets are, so that the texts stay where they are
    first = F.broadcast(first) if n_buckets <= BROADCAST_BUCKETS else first.repartition(n_buckets, *keys)
    placed = shuffled.join(first, keys).select("first", F.posexplode("rows").alias("at", "row")).select("row.doc_id", "row.text", (F.col("first") + F.col("at")).alias("place"))
    least, longer = divmod(total["n"], n_shards)
    before = longer * (least + 1)  # the places that the longer shards take
    shard = F.when(F.col("place") < before, F.floor(F.col("place") / (least + 1))).otherwise(longer + F.floor((F.col("place") - before) / max(least, 1))).cast("int")
    start = F.col("shard") * least + F.least(F.col("shard"), F.lit(longer))
    sharded = placed.withColumn("shard", shard).select("doc_id", "text", "shard", (F.col("place") - start).cast("long").alias("slot"))
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.sparkSession.read.schema(f"doc_id {kind}, text string, slot long, shard int").parquet(path)


def shard_digest(docs: DataFrame, n_shards: int = 16, **options) -> DataFrame:
    """Where each row went, from the written shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    written = write_shards(docs, fresh_path(docs.sparkSession, "shards"), n_shards, **options)
    size = F.octet_length("text").cast("long") + 1
    return written.select("doc_id", size.alias("size"), F.crc32("text").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
