"""Tables written once, where a plan would otherwise be computed anew for each of its uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; a local master without it gets one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_folder, "own", None):
        shared_folder.own = "file://" + tempfile.mkdtemp(prefix="tickloom-")
    return shared_folder.own


def once(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read from there; lost executors cost nothing that is in it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
