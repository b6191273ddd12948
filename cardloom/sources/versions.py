"""Day tables in versions: a reader never sees half a day.

``data/<version>/<day>=...`` holds what one write has made, ``current/<day>`` names the version that counts for a day. Data is
written first, then each day's pointer is replaced in one atomic rename; until then readers have the version before. A write
that dies leaves data that no pointer names; the same version written again replaces it.

Writes of thousands of days point to them all in one file, ``commits/<number>``, which holds for each day that was ever pointed
to so its version and that commit's number; the largest number counts. A day's own pointer says behind which commit it came, so of
the two ways the later one counts.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _text(spark: SparkSession, store, file) -> str:
    stream = store.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _commits(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the commits, in order."""
    store, folder = _store(spark, path), _path(spark, path, "commits")
    names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def _committed(spark: SparkSession, path: str, number: int) -> dict[str, list]:
    """(version, number of its commit) of each day up to a commit."""
    return json.loads(_text(spark, _store(spark, path), _path(spark, path, "commits", str(number)))) if number else {}


def current(spark: SparkSession, path: str) -> dict[str, str]:
    """The version of each day."""
    store, folder = _store(spark, path), _path(spark, path, "current")
    held = _committed(spark, path, max(_commits(spark, path), default=0))
    for p in [s.getPath() for s in store.listStatus(folder)] if store.exists(folder) else []:
        if not p.getName().startswith((".", "_")):
            version, behind = _text(spark, store, p).rsplit("\n", 1)
            day = unquote(p.getName())
            if day not in held or held[day][1] <= int(behind):
                held[day] = [version, int(behind)]
    return {day: version for day, (version, _) in held.items()}


def _write(spark: SparkSession, path: str, file, text: str) -> None:
    stream = _store(spark, path).create(file, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _rename(spark: SparkSession, path: str, draft, final, *how: str) -> None:
    """An atomic rename; without the option OVERWRITE an error if the file is there."""
    fs = spark._jvm.org.apache.hadoop.fs
    kind = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, len(how))
    for k, name in enumerate(how):
        options[k] = getattr(kind, name)
    fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else _path(spark, f"file://{path}").toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)


def _point(spark: SparkSession, path: str, day: str, version: str) -> None:
    """Replace a day's pointer: a file beside it, then a rename that takes its place."""
    name = quote(day, safe="")
    draft, final = _path(spark, path, "current", f".{name}.{version}"), _path(spark, path, "current", name)
    _write(spark, path, draft, f"{version}\n{max(_commits(spark, path), default=0)}")
    _rename(spark, path, draft, final, "OVERWRITE")


def _point_all(spark: SparkSession, path: str, days: list[str], version: str) -> None:
    """Point all these days to a version at once: one file, whatever their number. Of two writers at a time the later one
    begins again behind the other's commit."""
    while days:
        last = max(_commits(spark, path), default=0)
        text = json.dumps(_committed(spark, path, last) | {d: [version, last + 1] for d in days})
        draft = _path(spark, path, "commits", f".{uuid.uuid4().hex}")
        _write(spark, path, draft, text)
        try:
            return _rename(spark, path, draft, _path(spark, path, "commits", str(last + 1)))
        except Py4JJavaError as e:
            _store(spark, path).delete(draft, False)
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise


def write_version(df: DataFrame, path: str, version: str, day: str = "run_date", sort_by: str | None = None) -> list[str]:
    """Write df as a version that no pointer names yet, each day in files of its own, sorted by ``sort_by`` with statistics
    for every few thousand rows. Returns its days. What a write of the same version has left is replaced."""
    rows = df.hint("rebalance", F.col(day))
    rows = rows.sortWithinPartitions(day, sort_by) if sort_by else rows
    # tasks move their files themselves, not the driver one after the other: no pointer names the version before the job's end
    out = rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("parquet.page.row.count.limit", 2000).option("parquet.enable.dictionary", sort_by is None)
    spark = df.sparkSession
    # times as INT96, the engine's way by default, have no statistics
    name = "spark.sql.parquet.outputTimestampType"
    old = spark.conf.get(name)
    spark.conf.set(name, "TIMESTAMP_MICROS")
    try:
        out.partitionBy(day).parquet(f"{path}/data/{version}")
    finally:
        spark.conf.set(name, old)
    names = [s.getPath().getName() for s in _store(spark, path).listStatus(_path(spark, path, "data", version))]
    return sorted(unquote(n.split("=", 1)[1]) for n in names if n.startswith(f"{day}="))


def publish(spark: SparkSession, path: str, version: str, days: list[str]) -> None:
    for d in days:
        _point(spark, path, d, version)


def publish_days(df: DataFrame, path: str, version: str, day: str = "run_date", sort_by: str | None = None) -> list[str]:
    """Replace exactly the days that df has; a version that is published already is left as it is. Returns the days."""
    spark = df.sparkSession
    done = [d for d, v in current(spark, path).items() if v == version]
    if done:
        # a replay: the first run may have died between two pointers
        held = [s.getPath().getName() for s in _store(spark, path).listStatus(_path(spark, path, "data", version))]
        days = sorted(unquote(n.split("=", 1)[1]) for n in held if n.startswith(f"{day}="))
    else:
        days = write_version(df, path, version, day, sort_by)
    publish(spark, path, version, [d for d in days if d not in done])
    return days


def read_days(spark: SparkSession, path: str, days: list[str] | None = None, day: str = "run_date") -> DataFrame | None:
    """The current rows, of all days or those named; None if there are none. Only their folders are read."""
    found = {d: v for d, v in current(spark, path).items() if days is None or d in days}
    parts = {}
    for d, v in sorted(found.items()):
        parts.setdefault(v, []).append(f"{path}/data/{v}/{day}={quote(d, safe=' -_.')}")
    tables = [spark.read.option("basePath", f"{path}/data/{v}").parquet(*own) for v, own in sorted(parts.items())]
    whole = None
    for t in tables:
        whole = t if whole is None else whole.unionByName(t, allowMissingColumns=True)
    return whole


def scan_range(spark: SparkSession, path: str, value: str, column: str, begin: Column, end: Column, day: str = "run_date") -> DataFrame | None:
    """One day's rows with ``begin`` <= column < ``end``: that day's folder alone, and of its files, if they were written with
    ``sort_by`` this column, few pages beyond the range."""
    rows = read_days(spark, path, [value], day)
    return None if rows is None else rows.where((F.col(column) >= begin) & (F.col(column) < end))


OUTCOMES = "day string, rows long, outcome string, message string"


def publish_validated(df: DataFrame, path: str, version: str, valid: Column, day: str = "run_date", refresh: bool = True) -> DataFrame:
    """(day, rows, outcome, message): what has become of each day of df.

    ``written``: the day's rows satisfy ``valid`` (an aggregate) and count from now on; ``skipped``: they don't, and the day keeps
    what it had; ``from_cache``: with ``refresh`` off a day that has a version already keeps it, and isn't written at all;
    ``write_error``: it couldn't be written, with the error's first line. df is computed once; the check reads what was written.
    """
    spark = df.sparkSession
    there = current(spark, path)
    kept = [] if refresh else sorted(there)
    label = F.col(day).cast("string")
    fresh = df.join(F.broadcast(spark.createDataFrame([(d,) for d in kept], "_kept string")), label == F.col("_kept"), "left_anti") if kept else df
    rows = [(d, None, "from_cache", None) for d in kept]
    try:
        days = write_version(fresh, path, version, day)
    except AnalysisException:
        raise  # a wrong column is no matter of the store
    except Exception as e:
        return spark.createDataFrame([*rows, (None, None, "write_error", str(e).splitlines()[0][:300])], OUTCOMES)
    if days:
        written = spark.read.schema(df.schema).parquet(f"{path}/data/{version}")
        checked = written.groupBy(F.col(day).cast("string").alias("d")).agg(F.count("*").alias("n"), F.coalesce(valid, F.lit(False)).alias("ok")).collect()
        good = {r.d for r in checked if r.ok and r.d is not None}
        _point_all(spark, path, sorted(good), version)
        rows += [(r.d, r.n, "written" if r.d in good else "skipped", None) for r in checked]
    return spark.createDataFrame(rows, OUTCOMES)


def remove_old(spark: SparkSession, path: str, keep: set[str] = frozenset()) -> list[str]:
    """Delete the versions that no pointer names, but for those in ``keep`` (writes that go on). Returns them."""
    store, folder = _store(spark, path), _path(spark, path, "data")
    if not store.exists(folder):
        return []
    for n in _commits(spark, path)[:-10]:  # a writer that is about to follow one of the last finds its place taken
        store.delete(_path(spark, path, "commits", str(n)), False)
    named = set(current(spark, path).values()) | set(keep)
    gone = sorted(s.getPath().getName() for s in store.listStatus(folder) if s.getPath().getName() not in named)
    for v in gone:
        store.delete(_path(spark, path, "data", v), True)
    return gone
