"""Intermediate tables in the folder that the cluster shares: spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, where none is set, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_.get() if set_.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="melisma-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written once and read back: what follows doesn't redo it, and lost executors cost a task. It is joined by merging: its size
    on disk says little about its rows, which may be packed tightly or unrolled later, and the driver would build them all where a
    few MB of files are planned as a broadcast."""
    path = f"{shared_dir(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
