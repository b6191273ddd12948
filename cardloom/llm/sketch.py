"""Document fingerprints by a threshold-scaled sketch.

Every word shingle whose 64-bit hash lies below a fixed share of the hash range is kept, so
sketches of texts of very unequal length stay comparable: they are merged by union, and the
share of one's hashes found in the other estimates containment. Of a text none of whose
shingles lie below the threshold, the smallest hash alone is kept, so that no text with words
is without a sketch; ``merged`` drops such a hash where the other text has some below.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, U64, ids_and_texts, mixed, partitions, raw_bytes, small_batches, span_hashes, text_chunks, tidy, word_bounds

WORDS, ONE_IN = 5, 8


def sketches(texts: pa.ChunkedArray | pa.Array, words: int = WORDS, one_in: int = ONE_IN) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of everything kept, sorted by both, each pair once."""
    data, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    data = LOWER[data]
    is_word = ~IS_SPACE[data]
    starts, stops, row = word_bounds(is_word, offsets)
    h = span_hashes(data, is_word, starts, stops)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    total = h.copy()
    for k in range(1, words):
        total[:-k or None] += np.where(row[k:] == row[:-k], h[k:], U64(0)) * U64(2 * k * 0x9E3779B1 + 1)
    per_row = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    begin = np.repeat(first - np.cumsum(per_row) + per_row, per_row) + np.arange(int(per_row.sum()))
    shingle, owner = mixed(total[begin] + U64(words)), row[begin]
    keep = shingle <= U64((1 << 64) // one_in - 1)
    some = np.flatnonzero(per_row)
    if len(some):
        cuts = (np.cumsum(per_row) - per_row)[some]
        least = np.minimum.reduceat(shingle, cuts)
        bare = ~np.logical_or.reduceat(keep, cuts)
        keep |= (shingle == np.repeat(least, per_row[some])) & np.repeat(bare, per_row[some])
    owner, shingle = owner[keep], shingle[keep]
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])] if len(owner) else np.zeros(0, bool)
    return owner[new], shingle[new]


def texts_of(n: int, rows: np.ndarray, hashes: np.ndarray) -> list[str]:
    """A sketch as text: its hashes in ascending order, 16 hex digits each."""
    cuts = np.searchsorted(rows, np.arange(n + 1)).tolist()
    whole = hashes.astype(">u8").tobytes().hex()
    return [whole[16 * a : 16 * b] for a, b in zip(cuts, cuts[1:], strict=False)]


def containment(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each of n pairs, the share of the smaller sketch found in the other; two empty ones: 1, one empty: 0."""
    rows, hashes = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    both = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])], minlength=n)
    size_a, size_b = np.bincount(a[0], minlength=n), np.bincount(b[0], minlength=n)
    least = np.minimum(size_a, size_b)
    return np.where(least > 0, both / np.maximum(least, 1), (size_a == size_b).astype(float))


def estimate(a: Column, b: Column) -> Column:
    """The same estimate for two sketch columns in their text form."""
    x, y = (F.array_distinct(F.expr(f"regexp_extract_all({c}, '.{{16}}', 0)")) for c in (a, b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise((F.size(x) == F.size(y)).cast("double"))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, one_in: int = ONE_IN) -> DataFrame:
    """(doc_id, fingerprint) for every row: the kept hashes, 16 hex digits each, ascending.

    A-Z become lower case, words are split at ASCII white space; a text of fewer words has one
    shingle; a text without words (null, empty, blank) has an empty sketch.
    """
    rows = ids_and_texts(docs, id_col, text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            yield pa.record_batch({"doc_id": chunk.column("doc_id").combine_chunks(), "fingerprint": pa.array(texts_of(chunk.num_rows, *sketches(chunk.column("text"), words, one_in)))})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def merged(a: Column, b: Column, one_in: int = ONE_IN) -> Column:
    """The sketch of two texts' shingles together, from their sketches in text form: the union of what lies below
    the threshold, or the smallest hash if nothing does."""
    both = F.array_sort(F.array_union(*[F.expr(f"regexp_extract_all({c}, '.{{16}}', 0)") for c in (a, b)]))
    limit = f"{(1 << 64) // one_in:016x}"
    low = F.filter(both, lambda h: h < limit)  # hexadecimal digits of one length sort as numbers do
    return F.array_join(F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1)), "")


def _part_of(x: Column, bounds: list, kind) -> Column:
    """How many of the bounds (ascending) are at most x: first among every m-th, then among m."""
    if not bounds:
        return F.lit(0)
    m = math.isqrt(len(bounds)) + 1
    count = lambda cuts: F.size(F.filter(cuts, lambda b: b <= x))
    every = F.array(*[F.lit(b).cast(kind) for b in bounds])
    coarse = count(F.array(*[F.lit(b).cast(kind) for b in bounds[m - 1 :: m]])) * m
    return coarse + count(F.slice(every, coarse + 1, m))


def with_next(rows: DataFrame) -> DataFrame:
    """(doc_id, text, ghost) in ascending order of (doc_id, text) over partitions, each followed by the
    first row of the next (ghost = 1; after the last partition comes the first).

    Ids of any type that can be sorted; the ids alone are dealt by ranges first, and each range's
    smallest, a row for each partition, reaches the driver: these are the bounds.
    """
    n = partitions(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType
    ids = rows.select("doc_id").repartitionByRange(n, F.asc_nulls_first("doc_id"))
    lows = ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()
    bounds = sorted({r.low for r in lows if r.low is not None})
    nulls = any(r.nulls for r in lows)  # they come first, in a part of their own
    known = _part_of(F.col("doc_id"), bounds, kind) - (0 if nulls else 1)
    placed = rows.withColumn("part", F.greatest(F.when(F.col("doc_id").isNull(), 0).otherwise(known), F.lit(0)))
    count = len(bounds) + nulls
    low = F.array(*[F.lit(x).cast(kind) for x in ([None] if nulls else []) + bounds]) if count else F.array().cast(f"array<{kind.simpleString()}>")
    here = F.struct(F.col("part").alias("to"), F.lit(0).alias("ghost"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(max(count, 1))).alias("to"), F.lit(1).alias("ghost"))
    to = F.when(F.col("doc_id").eqNullSafe(F.get(low, F.col("part"))), F.array(here, before)).otherwise(F.array(here))
    dealt = placed.select("doc_id", "text", F.explode(to).alias("dealt")).select("doc_id", "text", "dealt.to", "dealt.ghost")
    return dealt.repartitionById(max(n, count), "to").sortWithinPartitions("ghost", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")).drop("to")


@tidy
def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for chunk in text_chunks(batches):
        chunk = pa.concat_tables([held, chunk]) if held is not None else chunk
        held = chunk.slice(chunk.num_rows - 1)
        n = chunk.num_rows - 1
        real = np.flatnonzero(np.asarray(chunk.column("ghost").combine_chunks())[:n] == 0)
        if not len(real):
            continue
        n = len(real)  # real rows come first
        texts = [t or "" for t in chunk.column("text").slice(0, n + 1).to_pylist()]
        changed = []
        for text, after in zip(texts, texts[1:], strict=False):
            k = len(text) // 4
            changed.append(text[: len(text) - k] + after[:k])
        rows, hashes = sketches(chunk.column("text").slice(0, n + 1))
        edited = sketches(pa.array(changed, pa.string()))
        own = rows < n
        mine = rows[own], hashes[own]
        after = rows[rows > 0] - 1, hashes[rows > 0]
        yield pa.record_batch({
            "doc_id": chunk.column("doc_id").slice(0, n).combine_chunks(),
            "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            "fingerprint": pa.array(texts_of(n, *mine)),
            "edited_fingerprint": pa.array(texts_of(n, *edited)),
            "near_edited": pa.array(containment(n, mine, edited)),
            "near_next": pa.array(containment(n, mine, after)),
        })


def sketch_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every text, of its edited form and their containment estimates.

    Edited: the last quarter of the code points gives way to as many first ones of the next
    row in order of (id, text); after the last comes the first; null ids come first, null
    texts are empty.
    """
    rows = ids_and_texts(docs, id_col, text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(rows).mapInArrow(_edited, schema)


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sketch_of_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_scaled_sketch": op7_scaled_sketch}
ORACLES: dict[str, str] = {}
