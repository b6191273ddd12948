"""Which of many strings are contained in which of many texts: a join on short grams.

Needles of more than PIECE characters are cut into pieces. A piece is looked for by one of its runs of
SIZE characters, the one that is rarest in the texts of its run; shorter pieces by themselves. Texts are read twice,
once to count how often the needles' grams occur, once to find the chosen ones; both times a filter of bits, of
bounded size, says which places of a text are of interest, so the work for a text doesn't depend on the number of needles.
Only what stands around such places is sent to meet the needles, in an equi-join on the gram; no text is shuffled. The
comparison of the piece with what stands there decides, so hashes and filters never change the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import settled

#: Characters of a gram, and of a piece of a needle that is compared in one go.
SIZE, PIECE = 4, 128
#: Kinds of keys: pieces of 1 to SIZE characters, looked for whole, and grams inside longer ones.
INSIDE = SIZE + 1
#: Places of the counts (powers of two), places of a filter for each key, and the most it may have: 16 MB of bits.
COUNTS, PER_KEY, MOST_BITS = 20, 64, 27
#: Characters of text that are handled at once, and bytes of a batch that are taken apart at once.
CHARS, BYTES = 1 << 18, 1 << 21

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def _grams(codes: np.ndarray, q: int, salts: np.ndarray | None) -> np.ndarray:
    """A hash of the q characters from every place on."""
    n = max(len(codes) - q + 1, 0)
    h = np.zeros(n, U64)
    for k in range(q):
        h += codes[k : k + n]
        h *= _ODD
    return _mixed(h if salts is None else h ^ salts[:n])


def _kind_hash(h: np.ndarray, kind: int) -> np.ndarray:
    return h ^ U64(kind * 0x2545F4914F6CDD1D & (1 << 64) - 1)


def _size(kind: int) -> int:
    return min(kind, SIZE)


class _Filter:
    """Bits at two places for each hash it was made of."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where the hashes are that the filter has, and few others."""
        found = None
        for shift in (0, 64 - self.bits):
            at = ((h if found is None else h[found]) >> U64(shift)) & U64((1 << self.bits) - 1)
            hit = np.flatnonzero((self.words[(at >> U64(6)).view(np.int64)] >> (at & U64(63))) & U64(1))
            found = hit if found is None else found[hit]
        return found


def _segments(texts: list[str], over: int = SIZE - 1) -> Iterator[list[tuple[int, int, str]]]:
    """(row, where it begins, characters): whole texts, or parts of long ones that overlap by ``over``, some CHARS together."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for a in range(0, max(len(text) - over, 1), CHARS):
            part = text if len(text) <= CHARS else text[a : a + CHARS + over]
            held.append((row, a, part))
            size += len(part)
            if size >= CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of BYTES of text, and a row, at most: memory doesn't depend on how many rows Spark sends at once."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index("_text"))), 0), np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES, side="right")))
            yield batch.slice(a, b - a)
            a = b


def _probes(batch: pa.RecordBatch, kinds: list[int], interest: _Filter | None = None) -> Iterator[tuple[list[str], int, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, kind, hash, row, place) of the grams of a batch with the columns _text and _salt: all, or those in the filter."""
    texts = [t or "" for t in batch.column(batch.schema.get_field_index("_text")).to_pylist()]
    salts = np.asarray(batch.column(batch.schema.get_field_index("_salt"))).astype(np.int64).view(U64)
    for held in _segments(texts):
        codes = np.frombuffer("".join(s for _, _, s in held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
        lens = np.array([len(s) for _, _, s in held], np.int64)
        ends = np.cumsum(lens)
        rows = np.array([r for r, _, _ in held], np.int64)
        begins = np.array([a for _, a, _ in held], np.int64)
        salt = np.repeat(salts[rows], lens) if salts.any() else None
        made: dict[int, np.ndarray] = {}
        for kind in kinds:
            q = _size(kind)
            if q not in made:
                made[q] = _grams(codes, q, salt)
            h = _kind_hash(made[q], kind)
            at = np.arange(len(h)) if interest is None else interest.places(h)
            part = np.searchsorted(ends, at, side="right")
            place = at - (ends - lens)[part]
            inside = place + q <= lens[part]
            at, part, place = at[inside], part[inside], place[inside]
            # parts of a long text overlap by SIZE - 1 characters; shorter grams there are found twice, which does no harm
            yield texts, kind, h[at], rows[part], place + begins[part]


def _added(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])


def _bit_filter(keys: DataFrame, column: str, most: int) -> _Filter:
    """The filter of the hashes in a column, ``most`` at most; words of bits are put together before they come to the
    driver, a bounded number."""
    bits = min(MOST_BITS, max(16, (PER_KEY * most - 1).bit_length()))
    h = F.col(column)
    at = F.explode(F.array(h.bitwiseAND((1 << bits) - 1), F.shiftrightunsigned(h, 64 - bits)))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), U64)
    table[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(U64)
    return _Filter(table, bits)


def _pieces(needle):
    """Pieces of a needle, with the place of each; the last one ends with the needle."""
    n = F.length(needle)
    starts = F.when(n <= PIECE, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), n - PIECE, F.lit(PIECE)), F.array(n - PIECE))))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(needle, s + 1, F.lit(PIECE)).alias("piece")))


def pairs(texts: DataFrame, text: str, needles: DataFrame, needle: str, by: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry, needle): each needle once with each combination of the columns ``carry`` of the texts that contain it.

    With ``by``, columns of both, only texts of the needle's own run count, and the result has them too. Comparison is by
    code points, case and all. Null and empty needles are contained in nothing, null texts contain nothing.
    """
    spark = texts.sparkSession
    by, carry = list(by), [c for c in carry if c not in by]
    salt = F.xxhash64(*by) if by else F.lit(0).cast("long")
    wanted = needles.where(F.col(needle) != "").select(*by, F.col(needle).alias("_needle")).distinct()
    cut = wanted.withColumn("_all", _pieces(F.col("_needle"))).select(*by, "_needle", F.size("_all").alias("_count"), F.explode("_all").alias("_p"))
    cut = cut.select(*by, "_needle", "_count", F.col("_p.start").cast("long").alias("_start"), F.col("_p.piece").alias("_text"), salt.alias("_salt"))
    kind = F.least(F.length("_text"), F.lit(INSIDE))
    cut = settled(cut)  # the needles alone, cut into pieces
    kinds, most, n, size = cut.agg(F.array_sort(F.collect_set(kind)), F.max("_count"), F.count("*"), F.sum(F.length("_text"))).first()
    if not kinds:
        return texts.select(*by, *carry).join(needles.select(*by, F.col(needle).alias("needle")).where("false"), by or F.lit(True)).select(*by, *carry, "needle")
    kinds = [int(k) for k in kinds]
    cut_schema = cut.schema

    def own_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            lens = np.array([len(t) for t in batch.column(batch.schema.get_field_index("_text")).to_pylist()], np.int64)
            for _, kind, h, row, _ in _probes(batch, kinds):
                h = np.unique(h[np.minimum(lens[row], INSIDE) == kind])
                if len(h):
                    yield pa.record_batch({"h": pa.array(h.view(np.int64))})

    interest = spark.sparkContext.broadcast(_bit_filter(cut.mapInArrow(own_grams, "h long"), "h", size))
    source = texts.where(F.col(text).isNotNull()).select(*by, *carry, F.col(text).alias("_text"), salt.alias("_salt"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTS, np.int64)
        for batch in _cut(batches):
            for _, _, h, _, _ in _probes(batch, kinds, interest.value):
                np.add.at(total, (h & U64((1 << COUNTS) - 1)).view(np.int64), 1)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.record_batch({"at": pa.array(at), "n": pa.array(total[at])})

    # a million counts at most, whatever the texts and the needles
    found = source.select("_text", "_salt").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTS, np.float32)
    counts[np.asarray(found.column("at"))] = np.asarray(found.column("n"))
    often = spark.sparkContext.broadcast(counts)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece's key: its rarest gram, the first of several; a piece with a gram that no text has is dropped."""
        for batch in _cut(batches):
            pieces = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            lens = np.array([len(t) for t in pieces], np.int64)
            for _, kind, h, row, place in _probes(batch, kinds):
                mine = np.minimum(lens[row], INSIDE) == kind
                h, row, place = h[mine], row[mine], place[mine]
                if not len(h):
                    continue
                n = often.value[(h & U64((1 << COUNTS) - 1)).astype(np.int64)]
                order = np.lexsort((place, n, row))
                first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
                first = first[n[first] > 0]
                if len(first):
                    part = batch.take(pa.array(row[first]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h[first].view(np.int64)), pa.array(np.full(len(first), kind, np.int32)), pa.array(place[first])], schema=pa.schema([*part.schema, ("_h", pa.int64()), ("_kind", pa.int32()), ("_offset", pa.int64())]))

    keys = cut.mapInArrow(chosen, _added(cut_schema, ("_h", T.LongType()), ("_kind", T.IntegerType()), ("_offset", T.LongType())))
    places = spark.sparkContext.broadcast(_bit_filter(keys, "_h", n))
    several = most > 1

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            ids: dict[int, bytes] = {}
            rest = batch.drop_columns(["_text", "_salt"])
            for texts, kind, h, row, place in _probes(batch, kinds, places.value):
                if kind != INSIDE and len(h) and not several:  # that it is there is all that counts
                    _, once = np.unique(np.stack([row.astype(U64), h]), axis=1, return_index=True)
                    h, row, place = h[once], row[once], place[once]
                if not len(h):
                    continue
                windows, leads = [], []
                for r, p in zip(row.tolist(), place.tolist(), strict=True):
                    a = p if kind != INSIDE else max(0, p - PIECE)
                    windows.append(texts[r][a : p + (kind if kind != INSIDE else PIECE + SIZE)])
                    leads.append(p - a)
                    if several and r not in ids:
                        ids[r] = hashlib.blake2b(texts[r].encode("utf-8", "surrogatepass"), digest_size=16).digest()
                part = rest.take(pa.array(row)) if rest.num_columns else None
                yield pa.RecordBatch.from_arrays(
                    [*(part.columns if part else []), pa.array(h.view(np.int64)), pa.array(np.full(len(h), kind, np.int32)), pa.array(windows, pa.string()), pa.array(leads, pa.int64()), pa.array([ids.get(r) for r in row.tolist()], pa.binary()), pa.array(place)],
                    schema=pa.schema([*(part.schema if part else []), ("_h", pa.int64()), ("_kind", pa.int32()), ("_window", pa.string()), ("_lead", pa.int64()), ("_id", pa.binary()), ("_place", pa.int64())]),
                )

    kept = T.StructType([f for f in source.schema.fields if f.name not in ("_text", "_salt")])
    seen = source.mapInArrow(around, _added(kept, ("_h", T.LongType()), ("_kind", T.IntegerType()), ("_window", T.StringType()), ("_lead", T.LongType()), ("_id", T.BinaryType()), ("_place", T.LongType())))
    there = F.substring("_window", (F.col("_lead") - F.col("_offset") + 1).cast("int"), F.length("_text")) == F.col("_text")
    met = seen.join(keys.drop("_salt"), [*by, "_kind", "_h"]).where((F.col("_lead") >= F.col("_offset")) & there)
    if not several:
        return met.select(*by, *carry, F.col("_needle").alias("needle")).distinct()
    # all pieces of a needle at their places after one and the same begin
    at = met.select(*by, *carry, "_needle", "_count", "_start", "_id", (F.col("_place") - F.col("_offset") - F.col("_start")).alias("_begin"))
    whole = at.groupBy(*by, *carry, "_needle", "_count", "_id", "_begin").agg(F.countDistinct("_start").alias("_n")).where("_n = _count")
    return whole.select(*by, *carry, F.col("_needle").alias("needle")).distinct()
