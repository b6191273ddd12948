import random

import pytest
from pyspark.sql import functions as F

from cardloom.streaming import late


def batch(rows, grace):
    """Row by row in order of arrival."""
    out, latest, counts = {}, {}, {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[2])
        for arrival in sorted({r[2] for r in own}):
            before = latest.get(key)
            for _, day, a in own:
                if a == arrival:
                    gone = before is not None and day < before - grace
                    counts[key, day, gone] = counts.get((key, day, gone), 0) + 1
                    if not gone:
                        out.setdefault(key, []).append(day)
            latest[key] = max(out.get(key, [before])) if out.get(key) else before
        # days that a later arrival has closed
        ends = [max([d for k, d, a in own if a <= x]) for x in sorted({a for _, _, a in own})]
        closed = ends[-2] if len(ends) > 1 else None
        for (k, day, gone), n in list(counts.items()):
            if k == key and not gone and not (closed is not None and day < closed - grace):
                del counts[k, day, gone]
    return counts


@pytest.fixture
def store(spark):
    name, value = late.PROVIDER
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    yield
    spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def test_restart_and_micro_batches_change_nothing(spark, tmp_path, store):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), max(0, 3 * arrival - int(rng.expovariate(0.3))), arrival) for arrival in range(8) for _ in range(40)]
    schema = "provider string, day int, arrival int"
    df = spark.createDataFrame(rows, schema).withColumn("published_at", F.date_from_unix_date("day").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).drop("day")
    want = batch(rows, 2)
    assert any(gone for _, _, gone in want) and any(not gone for _, _, gone in want)
    for files, stops in ((1, (4, 8)), (3, (8,))):
        base = str(tmp_path / f"run{files}")
        for stop in stops:  # what has arrived by then, then a stop and a new start
            done = 0 if stop == stops[0] else stops[0]
            for a in range(done, stop):
                df.where(F.col("arrival") == a).coalesce(1).write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("latestFirst", False).parquet(f"{base}/in")
            counts = late.day_counts_and_late(stream, ["provider"])
            q = counts.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        got = {(r.provider, r.d, r.late): r.n for r in spark.read.parquet(f"{base}/out").groupBy("provider", F.unix_date("day").alias("d"), "late").agg(F.sum("n").alias("n")).collect()}
        assert got == want
