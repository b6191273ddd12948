"""Idempotent, validated writes by day."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite_days(df: DataFrame, path: str, day: str = "run_date") -> None:
    """Replace exactly the days that df has; other days stay. A rerun gives the same rows.

    Rows are dealt by day, so that a small day is one file; the adaptive planner cuts a large day's
    share into tasks of its advisory size.
    """
    df.hint("rebalance", F.col(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_validated(df: DataFrame, path: str, valid, day: str = "run_date") -> dict[str, int]:
    """Write only the days for which ``valid`` (an aggregate expression) holds; others keep what they have.

    Returns the number of days written and skipped. df is computed once, into a folder beside
    path; the check is one aggregation over its days, and the good ones go on from there.
    """
    held = f"{path}-unchecked-{uuid.uuid4().hex}"
    try:
        df.write.parquet(held)
        return _write_good_days(df.sparkSession.read.schema(df.schema).parquet(held), path, valid, day)
    finally:
        _delete(df.sparkSession, held)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _write_good_days(rows: DataFrame, path: str, valid, day: str) -> dict[str, int]:
    checked = rows.groupBy(day).agg(F.coalesce(valid, F.lit(False)).alias("_ok"))
    counts = checked.agg(F.count_if("_ok").alias("written"), F.count_if(~F.col("_ok")).alias("skipped")).first()
    if counts.written:
        overwrite_days(rows.join(checked.where("_ok").select(day), day, "left_semi").select(rows.columns), path, day)
    return {"written": counts.written, "skipped": counts.skipped}


def write_day(df: DataFrame, path: str, rescue_path: str, day: str = "run_date") -> str:
    """Overwrite df's days under path; if that fails, under rescue_path. Returns the path that has them."""
    try:
        overwrite_days(df, path, day)
    except Exception:
        overwrite_days(df, rescue_path, day)
        return rescue_path
    return path


ARCHIVE_SETS = ("confirmed", "refuted", "unverified", "out_of_window", "sources", "meta")


def write_archive(sets: dict[str, DataFrame], path: str, day: str = "run_date") -> None:
    """One dataset a set, by day, and a manifest; a missing set or a set without the day column is an error before any write."""
    for name in ARCHIVE_SETS:
        if name not in sets:
            raise ValueError(f"the archive lacks {name}")
        if day not in sets[name].columns:
            raise ValueError(f"{name} has no column {day}")
    for name in ARCHIVE_SETS:
        overwrite_days(sets[name], f"{path}/{name}", day)
    spark = sets["meta"].sparkSession
    manifest = [(json.dumps({"sets": list(ARCHIVE_SETS), "day": day}),)]
    spark.createDataFrame(manifest, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def scan_day(spark: SparkSession, path: str, value, day: str = "run_date") -> DataFrame:
    """The rows of one day; Spark reads that day's folder alone."""
    return spark.read.parquet(path).where(F.col(day) == value)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
