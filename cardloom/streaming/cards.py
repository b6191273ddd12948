"""Structured Streaming jobs over arriving cards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fields as f
from ..sources import versions
from ..sources.sinks import overwrite_days


def first_wins(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each URL identity once, as it first arrives; state is kept for ``delay`` of event time. Columns url, published_at."""
    keyed = stream.where(F.coalesce(F.trim("url"), F.lit("")) != "").withColumn("norm_url", f.norm_url(F.col("url")))
    return keyed.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["norm_url"])


def day_counts(stream: DataFrame, by: list[str], grace: str = "2 days", hours: int = 8) -> DataFrame:
    """Cards by local day; a day is final once the watermark has passed its end by the grace."""
    local = F.col("published_at") + F.make_interval(hours=F.lit(hours))
    counts = stream.withColumn("local", local).withWatermark("local", grace).groupBy(F.window("local", "1 day"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), *by, "n")


def late_rows(stream: DataFrame, days: int = 2, hours: int = 8) -> DataFrame:
    """Rows whose local day is more than ``days`` before the day they came in: counted, not silently lost. Columns published_at, ingested_at."""
    return stream.where(F.datediff(f.local_day(F.col("ingested_at"), hours), f.local_day(F.col("published_at"), hours)) > days)


def upsert_days(stream: DataFrame, raw_path: str, path: str, batch: Callable[[DataFrame], DataFrame], checkpoint: str, day: str = "run_date", **trigger) -> StreamingQuery:
    """Keep ``path`` as ``batch`` would make it of all rows so far: each micro-batch is added to raw_path under its number
    (a replay replaces it), and the days it touches are made anew and replaced."""

    def step(rows: DataFrame, number: int) -> None:
        rows = rows.withColumn("_batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch", day).parquet(raw_path)
        days = [r[0] for r in rows.select(day).distinct().collect()]  # those of one micro-batch
        whole = rows.sparkSession.read.parquet(raw_path).drop("_batch").where(F.col(day).isin(days))  # reads their folders alone
        overwrite_days(batch(whole), path, day)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upsert_versions(stream: DataFrame, raw_path: str, path: str, batch: Callable[[DataFrame], DataFrame], checkpoint: str, day: str = "run_date", **trigger) -> StreamingQuery:
    """The same into a table of versions (``sources.versions``): a reader has each day as it was before a micro-batch or after it,
    also where the batch dies between its writes; a replay takes up where it died."""

    def step(rows: DataFrame, number: int) -> None:
        rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch", day).parquet(raw_path)
        days = [r[0] for r in rows.select(day).distinct().collect()]  # those of one micro-batch
        if days:
            whole = rows.sparkSession.read.parquet(raw_path).where((F.col("_batch") <= number) & F.col(day).isin(days)).drop("_batch")
            versions.publish_days(batch(whole), path, f"b{number:010d}", day)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
