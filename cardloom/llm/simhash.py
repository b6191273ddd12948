"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints: 64 bits, a bit is 1 if set in over half of the XXH64 values (seed 42) of a
text's word shingles. Candidate search: each fingerprint is cut into two halves; of two
fingerprints that differ in at most 3 bits, one half differs in at most 1 bit. Each
distinct fingerprint is entered under its two halves and looks up the 32 neighbours of
each half; matches are verified over all 64 bits. Of a bucket's links a spanning forest is
emitted, never all pairs, so a large group of near copies costs rows in proportion to its
members while its connectivity stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, PACKED, U64, buckets_a_task, carried_type, carrying, exchanged, mixed, packed, partitions, raw_bytes, runs, small_batches, staged, text_chunks, tidy, word_bounds
from .components import connected_components, forest

BUCKET_ROWS = 50_000  # each with 66 records of 16 bytes


def shingle_hashes(texts: pa.ChunkedArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, row by row, and how many each row has."""
    data, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    data = LOWER[data]
    is_word = ~IS_SPACE[data]
    starts, stops, row = word_bounds(is_word, offsets)
    # words of one row, each followed by a space, so that a shingle is a slice
    lens = stops - starts + 1
    at = np.cumsum(lens) - lens
    line = np.full(int(lens.sum()), 0x20, np.uint8)
    keep = np.ones(len(line), bool)
    keep[at + lens - 1] = False
    line[keep] = data[is_word]
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    per_row = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    begin = np.repeat(first, per_row) + np.arange(int(per_row.sum())) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    end = begin + np.repeat(np.minimum(count, words), per_row) - 1
    whole, digest = line.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[a:b], 42) for a, b in zip(at[begin].tolist(), (at[end] + lens[end] - 1).tolist(), strict=True)), U64, len(begin))
    return hashes, per_row


def majority(hashes: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """For each row the bits set in over half of its hashes; 0 without any."""
    out = np.zeros(len(per_row), U64)
    some = np.flatnonzero(per_row)
    if len(some):
        cuts = np.r_[0, np.cumsum(per_row[some])]
        set_bits = np.zeros((len(some), 64), np.int64)
        for a in range(0, len(hashes), 1 << 16):
            b = min(a + (1 << 16), len(hashes))
            lo, hi = np.searchsorted(cuts, a, side="right") - 1, np.searchsorted(cuts, b, side="left")
            bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_bits[lo:hi] += np.add.reduceat(bits, np.maximum(cuts[lo:hi], a) - a, axis=0, dtype=np.int32)
        major = set_bits * 2 > per_row[some][:, None]
        out[some] = np.packbits(major.astype(np.uint8), axis=1, bitorder="little").view(U64).ravel()
    return out


def fingerprints_of(texts: pa.ChunkedArray, words: int, prints: int = 1) -> list[np.ndarray]:
    """The fingerprints of each text, as uint64: the first is that of the hashes, others of the hashes mixed anew."""
    hashes, per_row = shingle_hashes(texts, words)
    return [majority(mixed(hashes + U64(k)) if k else hashes, per_row) for k in range(prints)]


def _fingerprint_rows(words: int, prints: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            fps = fingerprints_of(chunk.column("text"), words, prints)
            yield pa.record_batch({
                "doc_id": chunk.column("doc_id").combine_chunks(),
                **{_name(k): pa.array(fp.view(np.int64)) for k, fp in enumerate(fps)},
                **({"carried": chunk.column("carried").combine_chunks()} if "carried" in chunk.column_names else {}),
            })

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, carry: list[str] = (), prints: int = 1) -> DataFrame:
    """(doc_id, fp: the fingerprint's 64 bits as a signed long, fp1 and so on with more ``prints``, carried), a row for
    each row of docs.

    carried: a struct of the row's columns named in ``carry`` (absent if none are).

    A-Z become lower case, words are split at ASCII white space, repeated shingles count
    each time. A text of fewer words has one shingle, the whole sequence; a text without
    words (null, empty, blank) has fingerprint 0.
    """
    rows = carrying(docs, id_col, text_col, carry)
    names = ", ".join(f"{_name(k)} long" for k in range(prints))
    return rows.mapInArrow(_fingerprint_rows(words, prints), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {names}{carried_type(rows)}")


def _name(k: int) -> str:
    return f"fp{k or ''}"


def _probes(per: int):
    """Packed (key, fingerprint) records: key = half number, half, and in the lowest bit whether it is a neighbour."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.r_[0, 1 << np.arange(32, dtype=np.int64)].astype(U64)
        for batch in batches:
            whole = np.asarray(batch.column(0)).view(U64)
            for a in range(0, len(whole), 20_000):
                fp = whole[a : a + 20_000]
                keys = []
                for side, half in enumerate((fp & U64(0xFFFFFFFF), fp >> U64(32))):
                    key = ((half[:, None] ^ flips[None, :]) | U64(side << 32)) << U64(1)
                    key[:, 1:] |= U64(1)
                    keys.append(key)
                key = np.concatenate(keys, axis=1).ravel()
                rec = np.empty(len(key), [("key", "<u8"), ("fp", "<u8")])
                rec["key"], rec["fp"] = key, np.repeat(fp, 66)
                slot = ((key >> U64(1)) * U64(0x9E3779B97F4A7C15)) >> U64(32)
                yield packed(((slot * U64(per)) >> U64(32)).astype(np.int64), rec)

    return run


def _near(x: np.uint64, ys: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(ys ^ x) <= most


def linked(entered: np.ndarray, looking: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links of one bucket: among the entered, and from entered to looking."""
    a: list[int] = []
    b: list[int] = []
    left, right = entered, looking  # not reached yet
    while len(left):
        queue = [(left[0], True)]
        left = left[1:]
        while queue and (len(left) or len(right)):
            x, inside = queue.pop()
            hit = _near(x, left, most)
            found = [(y, True) for y in left[hit]]
            left = left[~hit]
            if inside and len(right):
                hit = _near(x, right, most)
                found += [(y, False) for y in right[hit]]
                right = right[~hit]
            a += [int(x)] * len(found)
            b += [int(y) for y, _ in found]
            queue += found
    return a, b


def _links(most: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches):
            rec = np.frombuffer(b"".join(table.column("payload").to_pylist()), [("key", "<u8"), ("fp", "<u8")])
            rec = rec[np.argsort(rec["key"], kind="stable")]
            group = rec["key"] >> U64(1)
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.r_[cuts, len(group)])
            own = (rec["key"] & U64(1)) == 0
            entered = np.add.reduceat(own.astype(np.int64), cuts)
            two = cuts[(size == 2) & (entered > 0)]
            x, y = rec["fp"][two], rec["fp"][two + 1]
            ok = np.bitwise_count(x ^ y) <= most
            a, b = [x[ok].view(np.int64)], [y[ok].view(np.int64)]
            for c, n, e in zip(*(v[(size > 2) & (entered > 0)].tolist() for v in (cuts, size, entered)), strict=True):
                p, q = linked(rec["fp"][c : c + e], rec["fp"][c + e : c + n], most)
                a.append(np.array(p, U64).view(np.int64))
                b.append(np.array(q, U64).view(np.int64))
            low, high = forest(np.concatenate(a), np.concatenate(b))  # of the whole bucket's links
            yield pa.record_batch({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    return run


def near_links(fps: DataFrame, most: int = 3, rows: int | None = None) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column ``fp`` (long) that differ in at most
    ``most`` bits (up to 3), enough of them to keep every connection; null fingerprints have none.
    ``rows``: how many there are at most, if that is known; buckets are made of about BUCKET_ROWS each."""
    if not 0 <= most <= 3:
        raise ValueError("two halves with one flipped bit find at most 3 differing bits")
    spark = fps.sparkSession
    per_task = buckets_a_task(spark, fps.count() if rows is None else rows, BUCKET_ROWS)
    probes = fps.select("fp").where("fp IS NOT NULL").mapInArrow(_probes(partitions(spark) * per_task), PACKED)
    return exchanged(probes, per_task).mapInArrow(_links(most), "a long, b long")


def _classes(rows: DataFrame, name: str, most: int, n: int) -> DataFrame:
    """(name, class): every distinct fingerprint and the smallest that it reaches over links."""
    fps = rows.select(name).distinct()
    found = staged(connected_components(near_links(fps.select(F.col(name).alias("fp")), most, n), contracted=True), "components")
    return fps.join(found, fps[name] == found.node, "left").select(name, F.coalesce("component", name).alias("_class"))


def _united(rows: DataFrame, classes: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """classes (fp, class) after classes that rows of one class of ``more`` (name, class) have are made one."""
    pairs = staged(rows.select("fp", name).distinct().join(classes, "fp").join(more.withColumnRenamed("_class", "_other"), name).select("_class", "_other").distinct(), "pairs")
    low = pairs.groupBy("_other").agg(F.min("_class").alias("b"), F.count("*").alias("n")).where("n > 1")
    star = pairs.join(low, "_other").select(F.col("_class").alias("a"), "b")
    found = staged(connected_components(star), "components")
    return classes.join(found, classes._class == found.node, "left").select("fp", F.coalesce("component", "_class").alias("_class"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3, carry: list[str] = (), prints: int = 1) -> DataFrame:
    """(doc_id, fp, carried, component_id, component): the smallest doc_id reachable over links of ``most``
    bits, and a number that the group's rows alone have (several groups can have one smallest id).

    With more ``prints`` rows are linked if any of their fingerprints are, each kind searched in a
    table of its own: of looser near copies many more are found, for as much more work.
    Equal fingerprints are one node. Rows with a null id take part but name no group: a
    group of such rows alone has component_id null. Repeated rows are returned as often.
    """
    rows = staged(fingerprints(docs, id_col, text_col, words, carry, prints), "fingerprints")
    n = rows.count()
    classes = _classes(rows, "fp", most, n)
    for k in range(1, prints):
        classes = _united(rows, classes, _classes(rows, _name(k), most, n), _name(k))
    named = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes.withColumnRenamed("_class", "component"), "fp")
    lows = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(lows, "component").select(F.col("fp").alias("_fp"), "component_id", "component")
    return rows.join(of_fp, rows.fp == F.col("_fp"), "left").drop("_fp", *[_name(k) for k in range(1, prints)])


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
ORACLES: dict[str, str] = {}
