import datetime
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cardloom.sources import versions as vs
from cardloom.streaming import cards as sc

DAY = datetime.date(2026, 8, 1)


def days(spark, *rows):
    return spark.createDataFrame([(DAY + datetime.timedelta(d), n) for d, n in rows], "run_date date, n long")


def held(spark, path):
    df = vs.read_days(spark, path)
    return sorted((r.run_date.day, r.n) for r in df.collect()) if df is not None else []


def test_a_reader_has_whole_days(spark, tmp_path):
    path = str(tmp_path / "t")
    assert vs.read_days(spark, path) is None and vs.current(spark, path) == {} and vs.remove_old(spark, path) == []
    assert vs.publish_days(days(spark, (0, 1), (0, 2), (1, 3)), path, "v1") == ["2026-08-01", "2026-08-02"]
    before = vs.read_days(spark, path)
    vs.write_version(days(spark, (0, 9)), path, "v2")  # dies before the pointer
    assert held(spark, path) == [(1, 1), (1, 2), (2, 3)]
    vs.publish_days(days(spark, (0, 10)), path, "v2")  # the same version again
    assert held(spark, path) == [(1, 10), (2, 3)] and vs.current(spark, path) == {"2026-08-01": "v2", "2026-08-02": "v1"}
    assert sorted(r.n for r in before.collect()) == [1, 2, 3]  # who began to read before has what was there
    vs.publish_days(days(spark, (0, 77)), path, "v2")  # published versions stay
    assert held(spark, path) == [(1, 10), (2, 3)]
    vs.publish_days(days(spark, (1, 5)), path, "v3")
    assert vs.remove_old(spark, path) == ["v1"] and held(spark, path) == [(1, 10), (2, 5)]
    assert [r.n for r in vs.read_days(spark, path, ["2026-08-02"]).collect()] == [5]


def test_a_death_between_two_pointers(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "t"), vs._point
    vs.publish_days(days(spark, (0, 1), (1, 1)), path, "v1")

    def dying(spark, path, day, version):
        if day == "2026-08-02":
            raise KeyboardInterrupt
        real(spark, path, day, version)

    monkeypatch.setattr(vs, "_point", dying)
    with pytest.raises(KeyboardInterrupt):
        vs.publish_days(days(spark, (0, 2), (1, 2)), path, "v2")
    monkeypatch.setattr(vs, "_point", real)
    assert held(spark, path) == [(1, 2), (2, 1)]
    vs.publish_days(days(spark, (0, 2), (1, 2)), path, "v2")
    assert held(spark, path) == [(1, 2), (2, 2)]


def test_outcomes_of_a_validated_write(spark, tmp_path):
    path = str(tmp_path / "t")
    ok = F.count_if(F.col("n") > 0) > 0
    report = lambda *a, **k: {r.day: (r.rows, r.outcome) for r in vs.publish_validated(*a, **k).collect()}
    assert report(days(spark, (0, 1), (1, 0), (2, 5), (2, 0)), path, "v1", ok) == {"2026-08-01": (1, "written"), "2026-08-02": (1, "skipped"), "2026-08-03": (2, "written")}
    assert report(days(spark, (0, 0), (1, 4)), path, "v2", ok) == {"2026-08-01": (1, "skipped"), "2026-08-02": (1, "written")}
    assert held(spark, path) == [(1, 1), (2, 4), (3, 0), (3, 5)]
    assert report(days(spark, (0, 8), (5, 6)), path, "v3", ok, refresh=False) == {"2026-08-01": (None, "from_cache"), "2026-08-02": (None, "from_cache"), "2026-08-03": (None, "from_cache"), "2026-08-06": (1, "written")}
    assert (1, 8) not in held(spark, path)
    (tmp_path / "file").write_text("in the way")
    failed = vs.publish_validated(days(spark, (0, 1)), str(tmp_path / "file"), "v1", ok).collect()
    assert [(r.day, r.outcome) for r in failed] == [(None, "write_error")] and failed[0].message
    with pytest.raises(AnalysisException):
        vs.publish_validated(days(spark, (0, 1)), path, "v9", F.count_if(F.col("missing")) > 0)
    assert vs.publish_validated(days(spark, (0, 1)).limit(0), path, "v8", ok).count() == 0


def test_input_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = days(spark, *[(k % 3, k) for k in range(60)])
    vs.publish_validated(df.mapInArrow(counted, df.schema), str(tmp_path / "t"), "v1", F.count("*") > 0)
    assert seen.value == 60


def test_a_range_within_a_day_reads_few_pages(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(400_000).select(F.lit(DAY).alias("run_date"), F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(400_000))).alias("ts"), "id")
    vs.publish_days(rows, path, "v1", sort_by="ts")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    df = vs.scan_range(spark, path, "2026-08-01", "ts", at(100_000), at(101_000))
    query = df.select("id", "ts")
    assert query.count() == 1000
    plan = query._jdf.queryExecution().executedPlan()
    query._jdf.collectToPython() if hasattr(query._jdf, "collectToPython") else query.collect()
    scan = [p for p in iter_plan(plan) if "Scan parquet" in p.nodeName()][0]
    read = scan.metrics().apply("numOutputRows").value()
    assert 1000 <= read <= 20_000, read
    assert vs.scan_range(spark, path, "2026-09-01", "ts", at(0), at(1)) is None


def iter_plan(node):
    yield node
    for k in range(node.children().size()):
        yield from iter_plan(node.children().apply(k))


def test_a_killed_batch_is_replayed(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    events = spark.createDataFrame([(k, DAY + datetime.timedelta(k % 3), k // 20) for k in range(60)], "id long, run_date date, part int")
    for p in range(3):
        events.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def start():
        stream = spark.readStream.schema("id long, run_date date").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        return sc.upsert_versions(stream, f"{base}/raw", f"{base}/days", lambda rows: rows.groupBy("run_date").agg(F.count("*").alias("n")), f"{base}/ck")

    real, calls = vs.publish_days, []

    def dying(df, path, version, day="run_date", sort_by=None):
        calls.append(version)
        if version == "b0000000001" and calls.count(version) == 1:
            raise RuntimeError("killed between the raw write and the day write")
        return real(df, path, version, day, sort_by)

    monkeypatch.setattr(vs, "publish_days", dying)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    assert sum(n for _, n in held(spark, f"{base}/days")) == 20  # as it was after the first batch
    assert os.path.isdir(f"{base}/raw/_batch=1")
    start().awaitTermination()
    assert calls.count("b0000000001") == 2 and held(spark, f"{base}/days") == [(1, 20), (2, 20), (3, 20)]
