"""Queries that write and read back, or run a stream to its end over the whole events table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as f
from ..sources import parsing, sinks, versions
from ..streaming import cards as sc
from ..streaming import late
from .base import Plans, table, view

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder where driver and executors can write: under spark.checkpoint.dir, else (one machine) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-cardloom-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def dated(spark, sf):
    return view(spark, sf, "cards").withColumn("run_date", F.date_add(F.lit("2026-08-01").cast("date"), F.col("day_no")))


@P.add("validated_write", "SELECT DATE '2026-08-01' + day_no AS run_date, count(*) AS n, CAST(sum(seq) AS BIGINT) AS total FROM cards WHERE day_no % 5 <> 3 GROUP BY 1")
def validated_write(spark, sf):
    """Days without a card of site0 (every fifth here) are not written; a second run changes nothing."""
    out = workspace(spark, "validated")
    rows = dated(spark, sf).where("day_no % 5 <> 3 OR site <> 'site0'").select("seq", "site", "run_date")
    for _ in range(2):
        sinks.write_validated(rows, out, F.count_if(F.col("site") == "site0") > 0)
    return spark.read.parquet(out).groupBy("run_date").agg(F.count("*").alias("n"), F.sum("seq").alias("total"))


@P.add("day_overwrite", "SELECT DATE '2026-08-01' + day_no AS run_date, count(*) AS n, max(CASE WHEN day_no % 5 = 2 THEN 'new' ELSE 'old' END) AS version FROM cards WHERE day_no % 5 <> 2 OR prio = 0 GROUP BY 1")
def day_overwrite(spark, sf):
    """All days, then every fifth anew: only those change."""
    out = workspace(spark, "days")
    rows = dated(spark, sf).select("seq", "prio", "run_date", "day_no")
    sinks.write_day(rows.withColumn("version", F.lit("old")), out, out + "-rescue")
    sinks.write_day(rows.where("day_no % 5 = 2 AND prio = 0").withColumn("version", F.lit("new")), out, out + "-rescue")
    return spark.read.parquet(out).groupBy("run_date").agg(F.count("*").alias("n"), F.max("version").alias("version"))


@P.add("day_scan", "SELECT seq, site FROM cards WHERE day_no = 1")
def day_scan(spark, sf):
    out = workspace(spark, "scan")
    sinks.overwrite_days(dated(spark, sf).select("seq", "site", "run_date"), out)
    return sinks.scan_day(spark, out, "2026-08-02").select("seq", "site")


@P.add("archive_sets", "SELECT s AS name, DATE '2026-08-01' + CAST(seq % 4 AS INTEGER) AS run_date, count(*) AS n FROM claims, (SELECT unnest(['confirmed', 'refuted', 'unverified', 'out_of_window', 'sources', 'meta']) AS s, unnest([0, 1, 2, 3, 4, 5]) AS i) WHERE quality = 1 OR seq % 6 = i GROUP BY 1, 2")
def archive_sets(spark, sf):
    out = workspace(spark, "archive")
    c = view(spark, sf, "claims").withColumn("run_date", F.date_add(F.lit("2026-08-01").cast("date"), (F.col("seq") % 4).cast("int")))
    sinks.write_archive({name: c.where((F.col("quality") == 1) | (F.col("seq") % 6 == k)).select("seq", "board", "run_date") for k, name in enumerate(sinks.ARCHIVE_SETS)}, out)
    parts = [spark.read.parquet(f"{out}/{name}").groupBy("run_date").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "run_date", "n") for name in sinks.ARCHIVE_SETS]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def stream_of(spark: SparkSession, sf: str, make) -> tuple[DataFrame, str]:
    """A stream over the events, split by ten-day slices into files that arrive one after the other."""
    out = workspace(spark, "stream")
    e = table(spark, sf, "events").withColumn("published_at", F.col("ts").cast("timestamp"))
    rows = make(e)
    rows.write.partitionBy("slice").parquet(f"{out}/in")
    return spark.readStream.schema(spark.read.parquet(f"{out}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{out}/in"), out


def finish(df: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Run a stream until its input is used up, into Parquet, and read that."""
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{out}/ck").option("path", f"{out}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/out")


@P.add("stream_first_wins", "SELECT DISTINCT 'h.example/' || (user_id % 90) AS norm_url FROM events")
def stream_first_wins(spark, sf):
    """The URL identities that a deduplicated stream lets through."""
    make = lambda e: e.select("event_id", "published_at", F.concat(F.lit("https://www.H.example/"), F.col("user_id") % 90, F.lit("?e="), "event_id").alias("url"), (F.col("event_id") % 3).alias("slice"))
    stream, out = stream_of(spark, sf, make)
    return finish(sc.first_wins(stream, "60 days").select("norm_url"), out)


@P.add("stream_day_counts", "SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, event_type AS provider, count(*) AS n FROM events GROUP BY 1, 2")
def stream_day_counts(spark, sf):
    """Counts by local day from a stream; a last row far ahead closes all days before it."""
    def make(e):
        rows = e.select("published_at", F.col("event_type").alias("provider"), F.lit(0).alias("slice"))
        last = e.agg((F.max("published_at") + F.expr("INTERVAL 40 DAYS")).alias("published_at")).select("published_at", F.lit("end").alias("provider"), F.lit(1).alias("slice"))
        return rows.unionByName(last)

    stream, out = stream_of(spark, sf, make)
    done = finish(sc.day_counts(stream, ["provider"], "30 days"), out)
    return done.where("provider <> 'end'")


@P.add("stream_late_rows", "SELECT event_type AS provider, count(*) AS n FROM events WHERE date_diff('day', CAST(ts + INTERVAL 8 HOUR AS DATE), CAST(ts + to_hours(event_id % 100) + INTERVAL 8 HOUR AS DATE)) > 2 GROUP BY 1")
def stream_late_rows(spark, sf):
    make = lambda e: e.select("published_at", (F.col("published_at") + F.make_interval(hours=(F.col("event_id") % 100).cast("int"))).alias("ingested_at"), F.col("event_type").alias("provider"), (F.col("event_id") % 2).alias("slice"))
    stream, out = stream_of(spark, sf, make)
    return finish(sc.late_rows(stream).select("provider"), out).groupBy("provider").agg(F.count("*").alias("n"))


@P.add("stream_day_upsert", "SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS run_date, event_type AS provider, count(*) AS n FROM events GROUP BY 1, 2")
def stream_day_upsert(spark, sf):
    """Day tables kept by micro-batches equal those of one batch."""
    make = lambda e: e.select("event_id", F.col("event_type").alias("provider"), f.local_day(F.col("published_at")).alias("run_date"), (F.col("event_id") % 3).alias("slice"))
    stream, out = stream_of(spark, sf, make)
    q = sc.upsert_days(stream.drop("slice"), f"{out}/raw", f"{out}/days", lambda rows: rows.groupBy("run_date", "provider").agg(F.count("*").alias("n")), f"{out}/ck2")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/days").select("run_date", "provider", "n")


@P.add("stream_version_upsert", "SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS run_date, event_type AS provider, count(*) AS n FROM events GROUP BY 1, 2")
def stream_version_upsert(spark, sf):
    """The same day tables in versions, which readers see whole."""
    make = lambda e: e.select("event_id", F.col("event_type").alias("provider"), f.local_day(F.col("published_at")).alias("run_date"), (F.col("event_id") % 3).alias("slice"))
    stream, out = stream_of(spark, sf, make)
    q = sc.upsert_versions(stream.drop("slice"), f"{out}/raw", f"{out}/days", lambda rows: rows.groupBy("run_date", "provider").agg(F.count("*").alias("n")), f"{out}/ck2")
    q.awaitTermination()
    return versions.read_days(spark, f"{out}/days").select("run_date", "provider", "n")


_arrived = """SELECT event_type AS provider, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, date_diff('day', DATE '1970-01-01', CAST(ts + to_hours(event_id % 200) AS DATE)) AS arrival FROM events"""


@P.add("stream_late_by_watermark", f"""WITH a AS ({_arrived}), b AS (SELECT *, max(day) OVER (PARTITION BY provider ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
    ends AS (SELECT provider, max(before) AS closed FROM b GROUP BY 1), m AS (SELECT b.provider, day, coalesce(day < before - 2, false) AS late, closed FROM b JOIN ends e ON e.provider = b.provider)
    SELECT provider, day, late, count(*) AS n FROM m WHERE late OR day < closed - 2 GROUP BY 1, 2, 3""")
def stream_late_by_watermark(spark, sf):
    """Day counts as arrivals close them, and late rows counted apart; files of ten days of arrivals come one after the other."""
    out = workspace(spark, "late")
    e = table(spark, sf, "events").withColumn("published_at", F.col("ts").cast("timestamp"))
    rows = e.select(F.col("event_type").alias("provider"), "published_at", F.unix_date(F.to_date(F.col("published_at") + F.make_interval(hours=(F.col("event_id") % 200).cast("int")))).alias("arrival"))
    first, last = rows.agg(F.min("arrival"), F.max("arrival")).first()
    for begin in range(first or 0, (last or -1) + 1, 10):
        rows.where(F.col("arrival").between(begin, begin + 9)).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    name, value = late.PROVIDER
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        done = finish(late.day_counts_and_late(stream, ["provider"]), out)
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)
    return done.groupBy("provider", "day", "late").agg(F.sum("n").alias("n"))


@P.add("validated_outcomes", """WITH d AS (SELECT CAST(DATE '2026-08-01' + day_no AS VARCHAR) AS day, day_no % 5 <> 3 AS good, count(*) AS n FROM cards WHERE day_no % 5 <> 3 OR site <> 'site0' GROUP BY 1, 2)
    SELECT 1 AS run, day, n AS "rows", CASE WHEN good THEN 'written' ELSE 'skipped' END AS outcome FROM d
    UNION ALL SELECT 2, day, CASE WHEN good THEN NULL ELSE n END, CASE WHEN good THEN 'from_cache' ELSE 'skipped' END FROM d""")
def validated_outcomes(spark, sf):
    """What became of each day of two runs, the second of which keeps what is there."""
    out = workspace(spark, "outcomes")
    rows = dated(spark, sf).where("day_no % 5 <> 3 OR site <> 'site0'").select("seq", "site", "run_date")
    runs = [versions.publish_validated(rows, out, f"v{k}", F.count_if(F.col("site") == "site0") > 0, refresh=k == 1).select(F.lit(k).alias("run"), "day", "rows", "outcome") for k in (1, 2)]
    return runs[0].unionByName(runs[1])


@P.add("day_range_scan", "SELECT event_id, user_id FROM events WHERE CAST(ts + INTERVAL 8 HOUR AS DATE) = DATE '2024-01-10' AND ts >= TIMESTAMP '2024-01-09 20:00:00' AND ts < TIMESTAMP '2024-01-10 03:30:00'")
def day_range_scan(spark, sf):
    """Some hours of one day, from files sorted by time."""
    out = workspace(spark, "range")
    rows = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("published_at")).withColumn("run_date", f.local_day(F.col("published_at")))
    versions.publish_days(rows, out, "v1", sort_by="published_at")
    at = lambda s: F.to_timestamp(F.lit(s))
    found = versions.scan_range(spark, out, "2024-01-10", "published_at", at("2024-01-09 20:00:00"), at("2024-01-10 03:30:00"))
    return found.select("event_id", "user_id")
