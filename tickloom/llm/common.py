"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local master without the setting gets a temporary folder: there the
    driver and the executors are one process.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tickloom-")
    return shared_dir.own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def bound_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Let Arrow batches of this session end at about ``most_bytes``, unless it asks for less.

    A batch stands in the executor's memory and in the Python worker's, each with
    copies on the way; by rows alone, 10,000 texts of any length are one batch.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if held <= 0 or held > most_bytes:
        spark.conf.set(name, str(most_bytes))


def give_back() -> None:
    """Return this process's free memory to the system: workers live on after a task, each with what its largest task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that ends with ``give_back``."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def drop_rows(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (nulls match nulls).

    ``gone`` is renamed first, so columns of ``docs`` can have any names.
    """
    other = f"__gone_{uuid.uuid4().hex[:8]}"
    return docs.join(gone.select(F.col(key).alias(other)), docs[key].eqNullSafe(F.col(other)), "left_anti")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key for each row, and that column's name.

    A row of a Parquet file is told by the file and its place in it, which stay the
    same however the file is read, so nothing is written. Where rows come from
    elsewhere or two of them share a key, rows get a number and are written once.
    """
    key = f"__row_{uuid.uuid4().hex[:8]}"
    try:
        place = docs.metadataColumn("_metadata")
        rows = docs.withColumn(key, F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row")))
        if rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return rows, key
    except AnalysisException:
        pass  # not read from Parquet files
    path = fresh_path(docs.sparkSession, "rows")
    docs.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path), key


def small(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``keys``, a written table of two or three numbers a row, marked for broadcast if it has at most ``most`` rows; else it is joined by a shuffle."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; a full path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
