"""Rows that are written down once, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, in a session of one process, a temporary one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-cardloom-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed: what reads it several times doesn't compute it again, and lost executors lose
    nothing. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes it once nothing refers to it."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()
