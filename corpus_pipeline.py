"""A corpus pipeline of five stages, each one of the operators in ``tickloom.llm``.

Toxic documents go, then exact copies, then near copies (one document of each
group stays), then documents that hold benchmark text; the rest is packed. A
stage takes the Parquet files that its predecessor left and, but for the last,
returns the same columns. No SQL expresses the stages, so their results are
tested against brute force. Each stage bounds the session's Arrow batches in bytes,
as Python workers live on from stage to stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from tickloom.llm.common import bound_batches, cut, fresh_path, numbered, small, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay but those whose text is scored toxic, each by itself: nulls and empty texts stay, repeated rows go or stay together."""
    bound_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: of the smallest doc_id, nulls last, and of equal ids the first row as read."""
    rows, key = numbered(docs)
    verdicts = exact_dedup.exact_dedup(rows, carried=(key,)).where("group_size > 1")
    return without(rows, verdicts.select(key, F.col("text_sha256").alias("of"), "doc_id"), key).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of the smallest doc_id, nulls last, and of equal ids the first row as read."""
    bound_batches(spark)
    rows, key = numbered(docs)
    return without(rows, simhash.near_rows(rows, ["doc_id", key]).select(key, F.col("root").alias("of"), "doc_id"), key).select(docs.columns)


def without(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` without those of ``groups`` (key, of, doc_id) that aren't the first of theirs; most rows aren't moved if few go."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)
    first = groups.groupBy("of").agg(F.min(order).alias("first")).select(F.col(f"first.{key}").alias(key))
    gone = cut(groups.select(key).join(first, key, "left_anti"))
    return rows.join(small(gone), key, "left_anti")


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay whose text holds no benchmark item, each by itself: nulls and empty texts stay, repeated rows go or stay together."""
    bound_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
