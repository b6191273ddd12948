"""Exact removal of repeated byte strings by suffix sorting, one bucket at a time.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a document
with a smaller id. Suffixes matter only to that depth, and those that can tie at it share a
seed: in every string of LENGTH bytes the k-mer with the smallest hash is its seed, so equal
strings have equal seeds. Suffixes are bucketed by seed. Consecutive suffixes with one seed
travel as one short text (a fragment); seeds that only one document has are left out first,
by a round of hashes, and equal fragments of a block of documents are sent once, with their
smallest id, so a passage that very many documents share costs a record per block.

A seed that very many fragments share (a run of blanks, say) would be one huge group: its strings
are dealt one by one instead, by a hash of all LENGTH bytes, so equal ones still meet.

Each bucket is sorted in blocks of bounded size: suffixes by their first symbols, long ties
by ranks, made beforehand, of a difference-cover sample of the block's text. Any two
suffixes have, within the cover's period, an offset at which both are in the sample, so the
ranks there settle their order. Neighbours in that order that agree to the depth are a group;
its smallest document keeps the string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_a_task, PACKED, U64, _WEIGHTS, carried_type, carrying, exact_groups, exchanged, give_back, inverse_powers, mixed, partitions, powers, raw_bytes, runs, small_batches, span_sums, tidy

LENGTH = 50
SEED = 20
WINDOW = LENGTH - SEED + 1
SEGMENT = (1 << 20) - 64
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20  # of text whose fragments one bucket sorts
NO_ID = np.iinfo(np.int64).max

PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)  # every difference modulo PERIOD is that of two of COVER
_shift = np.full((PERIOD, PERIOD), -1, np.int64)
for _a in COVER:
    for _b in COVER:
        _d = (_b - _a) % PERIOD
        for _i in range(PERIOD):
            _shift[_i, (_i + _d) % PERIOD] = (_a - _i) % PERIOD


def seeds(data: np.ndarray) -> np.ndarray:
    """For every place with LENGTH bytes after it: the place of its seed in the low 24 bits, the seed's hash (40 bits) above."""
    eight = data[: len(data) - 7].astype(U64)
    for k in range(1, 8):
        eight |= data[k : len(data) - 7 + k].astype(U64) << U64(8 * k)
    n = len(data) - SEED + 1
    h = eight[:n] * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(31)
    h = (h + eight[8 : n + 8]) * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h = mixed(h + (eight[SEED - 8 : n + SEED - 8] >> U64(64 - 8 * (SEED - 16))))
    h = (h & ~U64(0xFFFFFF)) | np.arange(n, dtype=U64)
    size = 1
    while size * 2 <= WINDOW:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (WINDOW - size)], h[WINDOW - size :])


class Fragments:
    """Runs of places of a block's rows whose strings have one seed, and the distinct ones among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        parts = []
        n = len(data)
        ok = np.zeros(n + 1, bool)
        lens = np.diff(offsets)
        long = lens >= LENGTH
        edge = np.zeros(n + 2, np.int32)
        np.add.at(edge, offsets[:-1][long], 1)
        np.add.at(edge, offsets[1:][long] - LENGTH + 1, -1)
        ok = np.cumsum(edge, dtype=np.int32)[: n + 1] > 0
        for a in range(0, max(0, n - LENGTH + 1), SEGMENT):
            part = data[a : a + SEGMENT + LENGTH - 1]
            seed = seeds(part)
            use = ok[a : a + len(seed)]
            first = use.copy()
            first[1:] &= (seed[1:] != seed[:-1]) | ~use[:-1]
            at = np.flatnonzero(first)
            last = use.copy()
            last[:-1] &= (seed[1:] != seed[:-1]) | ~use[1:]
            count = np.flatnonzero(last) - at + 1
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(_WEIGHTS[part] * powers(len(part)), out=sums[1:])
            end = at + count + LENGTH - 1
            text = mixed((sums[end] - sums[at]) * inverse_powers()[at] + count.astype(U64))
            # smallest hashes crowd at 0: spread them over all 40 bits, one to one
            spread = ((seed[at] >> U64(24)) * U64(0x9E3779B97F4A7C15)) & U64((1 << 40) - 1)
            parts.append((at + a, count, spread, text))
        self.at, self.count, self.seed, text = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
        self.id = ids[np.searchsorted(offsets, self.at, side="right") - 1]
        self.pick, self.of = exact_groups(text, data, self.at, self.count + LENGTH - 1)
        self.least = np.full(len(self.pick), NO_ID, np.int64)
        np.minimum.at(self.least, self.of, self.id)


def ordered(table: pa.Table) -> pa.Table:
    """A block's rows in one order, however the shuffle brought them: all rounds must number fragments alike."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def block_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = raw_bytes(table.column("text"))
    if len(data) >= 1 << 31:
        raise ValueError("a block of documents has over 2 GB of text; set a smaller block_bytes")
    ids = np.asarray(table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(NO_ID))
    return data, offsets, ids


def _bucket(seed: np.ndarray, buckets: int) -> np.ndarray:
    return (seed * U64(buckets) >> U64(40)).astype(np.int64)


def _seed_requests(f: Fragments, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct seeds in order, what it says of each, and where each bucket begins. Said: in the highest bit
    whether several of its documents have the seed, below the binary length of the number of its distinct strings' places."""
    order = np.argsort(f.seed, kind="stable")
    s, d = f.seed[order], f.id[order]
    first = np.zeros(len(s), bool)
    first[f.pick] = True
    places = np.where(first, f.count, 0)[order]
    cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    said = np.zeros(len(cuts), np.uint8)
    if len(cuts):
        several = np.minimum.reduceat(d, cuts) != np.maximum.reduceat(d, cuts)
        said = np.frexp(np.add.reduceat(places, cuts).astype(float))[1].astype(np.uint8) | (several.astype(np.uint8) << 7)
    return s[cuts], said, np.searchsorted(_bucket(s[cuts], buckets), np.arange(buckets + 1))


def _ask_seeds(buckets: int):
    @tidy
    def run(table: pa.Table) -> pa.Table:
        f = Fragments(*block_of(ordered(table)))
        seed, said, cuts = _seed_requests(f, buckets)
        low = seed.astype("<u4")
        own = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
        payload = [np.array([cuts[b + 1] - cuts[b]], "<u8").tobytes() + low[cuts[b] : cuts[b + 1]].tobytes() + said[cuts[b] : cuts[b + 1]].tobytes() for b in own]
        block = table.column("block")[0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array(own, pa.int32()), "tag": pa.array([block] * len(own), pa.int64()), "payload": pa.array(payload, pa.binary())})

    return run


def _answer_seeds(most: int):
    """most: places of strings with one seed that are sorted together."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two bits a seed: whether more than one document has it (or, rarely, one that looks like it), and whether it is hot."""
        for bucket, table in runs(batches):
            low, said = [], []
            for blob in table.column("payload").to_pylist():
                n = int(np.frombuffer(blob, "<u8", 1)[0])
                low.append(np.frombuffer(blob, "<u4", n, 8))
                said.append(np.frombuffer(blob, np.uint8, n, 8 + 4 * n))
            _, back, times = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
            says = np.concatenate(said)
            many = times > 1
            many[back[says >= 128]] = True
            places = np.bincount(back, weights=np.ldexp(1.0, (says & 127).astype(np.int32)), minlength=len(times))  # at most twice as many
            bits = np.stack([many[back], (many & (places > 2 * most))[back]], axis=1).ravel()
            cuts = np.cumsum([0, *map(len, low)]) * 2
            yield pa.record_batch({"block": table.column("tag").combine_chunks(), "bucket": pa.array(np.full(len(low), bucket, np.int32)), "payload": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})
            give_back()

    return run


def _ask_fragments(buckets: int):
    @tidy
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = ordered(table)
        data, offsets, ids = block_of(table)
        f = Fragments(data, offsets, ids)
        seed, _, cuts = _seed_requests(f, buckets)
        bits = np.zeros((len(seed), 2), bool)
        for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True):
            n = cuts[b + 1] - cuts[b]
            bits[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=2 * n).reshape(n, 2) > 0
        of_pick = bits[np.searchsorted(seed, f.seed[f.pick])] if len(seed) else bits
        # whole fragments, and of hot seeds single strings, under a hash of the string in place of the seed
        ask = np.flatnonzero(of_pick[:, 0] & ~of_pick[:, 1])
        hot = np.flatnonzero(of_pick[:, 1])
        n = f.count[f.pick[hot]]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hot = np.repeat(hot, n)
        single = f.at[f.pick[hot]] + step
        spread = string_hashes(data, single) >> U64(24)
        seeds_asked = np.concatenate([f.seed[f.pick[ask]], spread])
        begin = np.concatenate([f.at[f.pick[ask]], single])
        count = np.concatenate([f.count[f.pick[ask]], np.ones(len(hot), np.int64)])
        name = (np.concatenate([ask, hot]) << 5 | np.concatenate([np.zeros(len(ask), np.int64), step])).astype("<u4")
        least = f.least[np.concatenate([ask, hot])]
        order = np.argsort(_bucket(seeds_asked, buckets), kind="stable")
        seeds_asked, begin, count, name, least = (v[order] for v in (seeds_asked, begin, count, name, least))
        size = count + LENGTH - 1
        place = np.cumsum(size) - size
        text = data[np.arange(int(size.sum())) - np.repeat(place - begin, size)]
        place = np.r_[place, len(text)]
        cut = np.searchsorted(_bucket(seeds_asked, buckets), np.arange(buckets + 1))
        own = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        payload = []
        for b in own:
            x = slice(cut[b], cut[b + 1])
            payload.append(b"".join((np.array([x.stop - x.start], "<u8").tobytes(), seeds_asked[x].tobytes(), least[x].tobytes(), name[x].tobytes(), count[x].astype(np.uint8).tobytes(), text[place[cut[b]] : place[cut[b + 1]]].tobytes())))
        block = table.column("block")[0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array(own, pa.int32()), "tag": pa.array([block] * len(own), pa.int64()), "payload": pa.array(payload, pa.binary())})

    return run


def string_hashes(data: np.ndarray, at: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """A hash of the LENGTH bytes from each place on."""
    out = [np.zeros(0, U64)]
    for a in range(0, len(at), step):
        whole = data[at[a : a + step][:, None] + np.arange(LENGTH)[None, :]]
        out.append(mixed((_WEIGHTS[whole] * powers(LENGTH)[None, :]).sum(axis=1, dtype=U64)))
    return np.concatenate(out)


def packed_symbols(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols of nine bits from every place on, in one number that sorts as they do."""
    one = symbols.astype(U64)
    two = (one[:-1] << U64(9)) | one[1:]
    four = (two[:-2] << U64(18)) | two[2:]
    return (four[:-3] << U64(27)) | (two[4:-1] << U64(9))[: len(four) - 3] | one[6 : len(four) + 3]


def sorted_suffixes(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts``, and the packed symbols. Ends with at least 128 zeros.

    First by 35 symbols; ties by the ranks (over 56 symbols) of the cover sample at the offset
    where both suffixes meet it, in rounds that split all tied groups around a pivot at once.
    """
    packed = packed_symbols(symbols)
    n = len(symbols) - 128 + PERIOD
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    words = [packed[sample + 7 * k] for k in range(8)]
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), bool)
    for w in words:
        v = w[order]
        new[1:] |= v[1:] != v[:-1]
    rank = np.zeros(n, np.int32)
    rank[sample[order]] = np.cumsum(new)
    words = [packed[starts + 7 * k] for k in range(5)]
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for w in words:
        v = w[order]
        new[1:] |= v[1:] != v[:-1]
    del words
    group = np.cumsum(new) - 1
    size = np.bincount(group) if len(group) else group
    slots = np.flatnonzero(size[group] > 1)  # places of the order that belong to ties
    while len(slots):
        item = starts[order[slots]]
        tie = group[slots]
        cuts = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]])
        count = np.diff(np.r_[cuts, len(tie)])
        pivot = np.repeat(item[cuts + count // 2], count)
        k = _shift[item % PERIOD, pivot % PERIOD]
        side = np.sign(rank[item + k].astype(np.int64) - rank[pivot + k])
        turn = np.argsort(tie * 3 + side + 1, kind="stable")
        order[slots] = order[slots][turn]
        tie, side = tie[turn], side[turn]
        part = tie * 3 + side + 1
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        count = np.diff(np.r_[cuts, len(part)])
        left = np.repeat(count, count) > 1
        left &= side != 0
        group[slots] = np.repeat(slots[cuts] + len(order), count)  # new names, distinct
        slots = slots[left]
    return order, packed


def earlier(symbols: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every suffix whether one with a smaller id begins with the same LENGTH symbols."""
    order, packed = sorted_suffixes(symbols, starts)
    s = starts[order]
    same = np.ones(max(0, len(s) - 1), bool)
    for k in (*range(0, LENGTH - 7, 7), LENGTH - 7):
        w = packed[s + k]
        same &= w[1:] == w[:-1]
    cuts = np.flatnonzero(np.r_[True, ~same]) if len(s) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(ids[order], cuts), np.diff(np.r_[cuts, len(s)]))
    out = np.zeros(len(s), bool)
    out[order] = least < ids[order]
    return out


def text_hashes(text: np.ndarray, place: np.ndarray, size: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """A hash of each fragment's bytes, some thousand fragments at a time."""
    out = [np.zeros(0, U64)]
    for a in range(0, len(place), step):
        p, n = place[a : a + step], size[a : a + step]
        out.append(mixed(span_sums(_WEIGHTS[text[p[0] : p[-1] + n[-1]]], p - p[0], n) + n.astype(U64)))
    return np.concatenate(out)


def _answer_fragments(most: int):
    """most: suffixes sorted together (somewhat more if one seed has more)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, table in runs(batches):
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for k, blob in enumerate(table.column("payload").to_pylist()):
                n = int(np.frombuffer(blob, "<u8", 1)[0])
                parts = np.frombuffer(blob, "<u8", n, 8), np.frombuffer(blob, "<i8", n, 8 + 8 * n), np.frombuffer(blob, "<u4", n, 8 + 16 * n), np.frombuffer(blob, np.uint8, n, 8 + 20 * n).astype(np.int64), np.full(n, k), np.frombuffer(blob, np.uint8, -1, 8 + 21 * n)
                for c, p in zip(cols, parts, strict=True):
                    c.append(p)
            seed, least, name, count, source, text = map(np.concatenate, cols)
            size = count + LENGTH - 1
            place = np.cumsum(size) - size
            # equal fragments are sorted once, with their smallest id; all their places go from those with larger ones
            pick, of = exact_groups(text_hashes(text, place, size), text, place, size)
            first = np.full(len(pick), NO_ID, np.int64)
            np.minimum.at(first, of, least)
            mask = np.where(least > first[of], (U64(1) << count.astype(U64)) - U64(1), U64(0))
            order = pick[np.argsort(seed[pick], kind="stable")]
            least_of = np.full(len(seed), NO_ID, np.int64)
            least_of[pick] = first
            cuts = np.flatnonzero(np.r_[True, seed[order][1:] != seed[order][:-1]])
            times = np.diff(np.r_[cuts, len(order)])
            order = order[np.repeat(times > 1, times)]
            more = np.zeros(len(seed), U64)
            ends = np.cumsum(count[order])
            a = 0
            while a < len(order):
                b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right"))
                b = max(b, a + 1)
                b = int(np.searchsorted(seed[order], seed[order[b - 1]], side="right"))  # whole seeds
                own = order[a:b]
                at = np.cumsum(size[own] + 1) - size[own] - 1
                symbols = np.zeros(int((size[own] + 1).sum()) + 128, np.uint16)
                run_at = np.arange(int(size[own].sum())) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
                symbols[np.repeat(at, size[own]) + run_at] = text[np.repeat(place[own], size[own]) + run_at].astype(np.uint16) + 1
                n = count[own]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                gone = earlier(symbols, np.repeat(at, n) + step, np.repeat(least_of[own], n))
                more[own] = np.add.reduceat(gone.astype(U64) << step.astype(U64), np.cumsum(n) - n)
                a = b
            mask |= more[pick][of]
            blocks = table.column("tag").combine_chunks()
            some = np.flatnonzero(mask)
            per = np.searchsorted(source[some], np.arange(len(blocks) + 1))
            yield pa.record_batch({
                "block": blocks,
                "bucket": pa.array(np.full(len(blocks), bucket, np.int32)),
                "payload": pa.array([np.array([y - x], "<u8").tobytes() + name[some[x:y]].tobytes() + mask[some[x:y]].tobytes() for x, y in zip(per, per[1:], strict=False)], pa.binary()),
            })
            give_back()

    return run


def _removed(kind: pa.DataType, as_text: bool):
    @tidy
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = ordered(table)
        data, offsets, ids = block_of(table)
        f = Fragments(data, offsets, ids)
        mask = np.zeros(len(f.pick), U64)
        for blob in answers.column("payload").to_pylist():
            n = int(np.frombuffer(blob, "<u8", 1)[0])
            name = np.frombuffer(blob, "<u4", n, 8)
            np.bitwise_or.at(mask, name >> 5, np.frombuffer(blob, "<u8", n, 8 + 4 * n) << (name & 31).astype(U64))
        edge = np.zeros(len(data) + 1, np.int32)
        later = f.id > f.least[f.of]
        np.add.at(edge, f.at[later], 1)
        np.add.at(edge, f.at[later] + f.count[later] + LENGTH - 1, -1)
        some = np.flatnonzero(~later & (mask[f.of] > 0))
        bits = (mask[f.of[some]][:, None] >> np.arange(WINDOW, dtype=U64)[None, :]) & U64(1)
        x, k = np.nonzero(bits)
        np.add.at(edge, f.at[some][x] + k, 1)
        np.add.at(edge, f.at[some][x] + k + LENGTH, -1)
        gone = np.cumsum(edge, dtype=np.int32)[:-1] > 0
        before = np.r_[False, gone[:-1]]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after = np.r_[gone[1:], False]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        begin, end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        row = np.searchsorted(offsets, begin, side="right") - 1
        per_row = np.bincount(row, minlength=table.num_rows)
        kept_at = np.r_[0, np.cumsum(~gone, dtype=np.int32)][offsets]
        kept = data[~gone].tobytes()
        if as_text:
            texts = [kept[x:y].decode("utf-8", "ignore") for x, y in zip(kept_at.tolist(), kept_at[1:].tolist(), strict=False)]
            null = np.asarray(table.column("text").combine_chunks().is_null())
            column = pa.array(texts, pa.string(), mask=null)
        else:
            column = pa.Array.from_buffers(pa.binary(), table.num_rows, [None, pa.py_buffer(kept_at.astype(np.int32).tobytes()), pa.py_buffer(kept)])
        carried = {"carried": table.column("carried").combine_chunks()} if "carried" in table.column_names else {}
        return pa.table({
            "doc_id": table.column("doc_id").combine_chunks().cast(kind),
            "n_bytes": pa.array(np.diff(offsets)),
            "spans": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_row)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - offsets[row]), pa.array(end - offsets[row])], ["begin", "end"])),
            "n_removed": pa.array(np.diff(offsets) - np.diff(kept_at)),
            "kept": column,
            **carried,
        })

    return run


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, sorted_together: int = 150_000, carry: list[str] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, n_removed, kept, carried) for every row of docs; ids are integers.

    carried: a struct of the row's columns named in ``carry`` (absent if none are).

    With ``as_text``, kept is a string without the bytes of code points that a removal cut, null
    where the text is.

    spans: the maximal removed byte ranges; kept: the other bytes, concatenated. Null texts are
    empty. Rows with equal ids don't make each other's bytes go; rows with a null id come after
    all others. Texts of fewer than 50 bytes are kept.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import IntegralType

    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} has to be an integer column: which copy stays is decided by its order")
    rows = carrying(docs, id_col, text_col, carry)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    per_task = buckets_a_task(spark, total, BUCKET_BYTES)
    buckets = partitions(spark) * per_task
    blocks = max(int(total // block_bytes) + 1, partitions(spark))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    id_type = rows.schema["doc_id"].dataType
    answer = "block long, bucket int, payload binary"
    shared = exchanged(rows.groupBy("block").applyInArrow(_ask_seeds(buckets), PACKED), per_task).mapInArrow(_answer_seeds(sorted_together), answer)
    asked = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_ask_fragments(buckets), PACKED)
    masks = exchanged(asked, per_task).mapInArrow(_answer_fragments(sorted_together), answer)
    schema = f"doc_id {id_type.simpleString()}, n_bytes long, spans array<struct<begin:long,end:long>>, n_removed long, kept {'string' if as_text else 'binary'}{carried_type(rows)}"
    return rows.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(_removed(to_arrow_type(id_type), as_text), schema)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = repeats_removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP9 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM d, UNNEST(range(n - {LENGTH - 1})) AS u(i) WHERE n >= {LENGTH}),
m AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s),
g AS (SELECT p.doc_id, p.i, lag(p.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS before FROM p JOIN m ON m.s = p.s WHERE m.least < p.doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM k GROUP BY doc_id, island),
e AS (SELECT r.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS since, h FROM r JOIN d ON d.doc_id = r.doc_id),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS last FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed, coalesce(t.spans, 0) AS n_spans,
  sha256(unhex(coalesce(t.head, '') || substr(d.h, 2 * coalesce(t.last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""

QUERIES = {"op9_suffix_array_dedup": op9_suffix_array_dedup}
ORACLES = {"op9_suffix_array_dedup": ORACLE_OP9}
