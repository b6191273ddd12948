"""Helpers that several operators of this subpackage share.

Vectorised text handling inside Arrow batches (numpy only), the shared folder of the
cluster, and the "packed exchange": one shuffle row for each (chunk, bucket) with the
records of that bucket packed in a binary column, so that a shuffle of hundreds of
millions of tiny records stays compact and every bucket is handled alone.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that a task handles in one go.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, in a session of one process, it is a temporary folder; on a
    cluster its absence is an error. Folders are the caller's to clear when the results are used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-cardloom-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a staged table that nothing reads any more."""
    spark, path = df.sparkSession, df.staged_at
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class _Kept:
    """What the tasks of one operator keep in a Python worker; workers outlive stages and serve other operators too."""

    owner = ""
    tables: dict = {}


def make_room(owner: str) -> None:
    """Drop what another operator's tasks have left in this Python worker."""
    if _Kept.owner != owner:
        _Kept.owner, _Kept.tables = owner, {}


def kept(key, make):
    """``make()``, made once in a Python worker until another operator's tasks come."""
    if key not in _Kept.tables:
        _Kept.tables[key] = make()
    return _Kept.tables[key]


def give_back() -> None:
    """Free memory of this worker to the system: Arrow's pool and the C heap keep it else, for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def tidy(run):
    """A function over batches, or over one group's tables, that leaves its worker small: other operators' tables go
    before it begins and free memory is given back when it ends."""

    def over_batches(batches):
        make_room(run.__module__)
        try:
            yield from run(batches)
        finally:
            give_back()

    def over_group(table):
        make_room(run.__module__)
        out = run(table)
        give_back()
        return out

    def over_groups(table, other):
        make_room(run.__module__)
        out = run(table, other)
        give_back()
        return out

    takes = run.__code__.co_varnames[: run.__code__.co_argcount]
    return over_batches if takes == ("batches",) else over_group if len(takes) == 1 else over_groups


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_a_task(spark: SparkSession, total: int, bucket: int) -> int:
    """How many buckets each task of an exchange handles, one after the other, so that none has much more than ``bucket`` of ``total``."""
    return max(1, -(-total // (bucket * partitions(spark))))


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts: Arrow batches of 1000 rows, unless the session has its own number. Queries and the pipeline
    set this in their session; operators leave a caller's session as it is and are best called with it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the needed columns, under fixed names, so that no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`") for c in more])


def carrying(docs: DataFrame, id_col: str, text_col: str, carry: list[str] = ()) -> DataFrame:
    """The same with the columns named in ``carry`` as a struct ``carried``, whatever their names."""
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *more)


def carried_type(rows: DataFrame) -> str:
    return f", carried {rows.schema['carried'].dataType.simpleString()}" if "carried" in rows.columns else ""


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.Table]:
    """Tables of whole rows with about ``limit`` bytes of text each; one long row may be larger."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        lens = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        begin = 0
        while begin < len(lens):
            upto = np.cumsum(lens[begin:]) + size
            take = int(np.searchsorted(upto, limit, side="right"))
            if take >= len(lens) - begin:
                held.append(batch.slice(begin))
                size = int(upto[-1])
                break
            take = max(take, 0 if held else 1)
            if take:
                held.append(batch.slice(begin, take))
            yield pa.Table.from_batches(held)
            held, size, begin = [], 0, begin + take
    if held:
        yield pa.Table.from_batches(held)


def raw_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the n+1 offsets of its rows; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets * 0
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_WEIGHTS = np.random.RandomState(7).randint(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = 1 << 20


def _power_table(base: np.uint64) -> np.ndarray:
    out = np.full(_TABLE, base)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def powers(n: int) -> np.ndarray:
    """_BASE ** i for i < n, modulo 2 ** 64; n is at most _TABLE."""
    return kept("powers", lambda: _power_table(_BASE))[:n]


def inverse_powers() -> np.ndarray:
    """_BASE ** -i for i < _TABLE."""
    return kept("inverse powers", lambda: _power_table(_INVERSE))


def same_spans(x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray, size: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Whether x and y have the same values from each at_x and at_y on, for as many places as size (above 0) says."""
    out = np.ones(len(size), bool)
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + step, side="right")))
        n = size[a:b]
        begin = ends[a:b] - n - done
        run = np.arange(int(n.sum()))
        equal = x[run + np.repeat(at_x[a:b] - begin, n)] == y[run + np.repeat(at_y[a:b] - begin, n)]
        out[a:b] = np.logical_and.reduceat(equal, begin)
        a = b
    return out


def exact_groups(hashes: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans (of size above 0) with the same bytes, told apart by their hashes and then by the bytes themselves:
    the first of each group, and each span's group."""
    of = np.zeros(len(hashes), np.int64)
    picks = [np.zeros(0, np.int64)]
    count = 0
    todo = np.arange(len(hashes))
    while len(todo):  # again only for spans whose hash another text has too
        _, pick, group = np.unique(hashes[todo], return_index=True, return_inverse=True)
        rest = np.flatnonzero(pick[group] != np.arange(len(todo)))
        span, first = todo[rest], todo[pick[group[rest]]]
        same = size[span] == size[first]
        same[same] = same_spans(data, at[span[same]], data, at[first[same]], size[span[same]])
        of[todo] = count + group
        picks.append(todo[pick])
        count += len(pick)
        todo = span[~same]
    return np.concatenate(picks), of


def span_sums(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each span (they follow each other without gaps) the sum of value * _BASE ** place in the span."""
    if len(values) <= _TABLE:
        return np.add.reduceat(values * powers(_TABLE)[: len(values)], begin) * inverse_powers()[begin]
    out = np.zeros(len(begin), U64)
    a = 0
    while a < len(begin):  # as many spans at once as the tables reach; a longer span alone
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + _TABLE, side="right")) - 1)
        if b == len(begin) - 1 and begin[b] + size[b] - begin[a] <= _TABLE:
            b += 1
        part = values[begin[a] : begin[b - 1] + size[b - 1]]
        if len(part) <= _TABLE:
            out[a:b] = np.add.reduceat(part * powers(_TABLE)[: len(part)], begin[a:b] - begin[a]) * inverse_powers()[begin[a:b] - begin[a]]
        else:
            factor = np.full(len(part), _BASE)
            factor[0] = 1
            out[a] = (part * np.cumprod(factor, dtype=U64)).sum(dtype=U64)
        a = b
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(29)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes that don't cross rows, and each run's row."""
    if not len(is_word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(is_word)]
    begins[inner] = is_word[inner]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = is_word[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, is_word: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; the spans are all the word bytes, in order."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = stops - starts
    return mixed(span_sums(_WEIGHTS[data[is_word]], np.cumsum(lens) - lens, lens) + lens.astype(U64) * _WEIGHTS[0])


def packed(bucket: np.ndarray, records: np.ndarray, tag: int = 0) -> pa.RecordBatch:
    """A row for each bucket with its records (a structured or plain array, in the order given)."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(bucket)] if len(bucket) else cuts
    blobs = [records[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
    return pa.record_batch({"bucket": pa.array(bucket[cuts].astype(np.int32)), "tag": pa.array(np.full(len(cuts), tag, np.int64)), "payload": pa.array(blobs, pa.binary())})


PACKED = "bucket int, tag long, payload binary"


def exchanged(df: DataFrame, per_task: int) -> DataFrame:
    """Packed rows dealt by bucket: ``per_task`` buckets in each partition, sorted, so that one is held at a time."""
    n = partitions(df.sparkSession)
    return df.repartitionById(n, (F.col("bucket") / per_task).cast("int") % n).sortWithinPartitions("bucket", "tag")


def runs(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows with the same key as one table."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if now is not None and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
