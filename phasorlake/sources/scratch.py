"""Tables that a computation writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """That of ``spark.checkpoint.dir``; in local mode without one, a new temporary folder, which is then set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet and read it again, so that later jobs, and tasks that run again after a loss, see the
    same rows."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
