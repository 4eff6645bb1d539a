"""Folders that driver and executors share, for what is written once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the session's spark.checkpoint.dir; only a session on one machine may do without one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loomstone-')}")
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str) -> DataFrame:
    """The rows of `frame`, written to a shared folder and read from there."""
    spark, path = frame.sparkSession, shared_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
