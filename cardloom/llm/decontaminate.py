"""Benchmark decontamination with an FM-index for each shard of the corpus.

A shard is some MB of a task's documents. Its words become symbols: a word that occurs in
the benchmark has its number there, all others, and the ends of documents, are separators.
Runs of known words too short for the shortest window can't hold one and become one
separator. The shard's index is its Burrows-Wheeler transform in a wavelet matrix plus
sampled suffix positions. All benchmark windows are searched at once, backwards, one rank
query for each word and bound; occurrences are located by walking to the nearest sampled
position, and overlapping or touching spans are merged. Documents never leave their task;
the benchmark is broadcast in blocks of limited size, over several passes if it is large: a block of
4 MB of items is some 25 MB in the driver and in each Python worker, and two of them make a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, carried_type, carrying, exact_groups, raw_bytes, same_spans, small_batches, span_hashes, staged, text_chunks, tidy, word_bounds

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
SHARD_BYTES = 2 << 20
SPANS = "array<struct<begin:int,end:int>>"


class WaveletMatrix:
    """Rank and access over a sequence of small numbers, a bit level at a time."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            ones = self.ones[k][at].astype(np.int64)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.start[symbol]

    def access_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            ones = self.ones[k][at].astype(np.int64)
            bit = self.ones[k][at + 1] - ones
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return symbol, at - self.start[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; every 0 is a separator of its own, ordered by place, so ties end there."""
    n = len(text)
    stop = text == 0
    rank = np.where(stop, np.cumsum(stop) - 1, text.astype(np.int64) + int(stop.sum()))
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:-k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        k *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, every: int = 16):
        sa = suffix_array(text)
        before = text[sa - 1]  # of the first suffix, the last symbol, a separator
        self.rows = len(text)
        self.matrix = WaveletMatrix(before.astype(np.int64), symbols)
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))[:-1]].astype(np.int64)
        sampled = (sa % every == 0) | (before == 0)
        self.sampled = sampled
        self.order = np.cumsum(sampled) - 1
        self.samples = sa[sampled]

    def search(self, symbols: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase: ``size`` symbols (above 0) from each start on."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.rows, np.int64)
        live = np.arange(len(starts))
        for k in range(size - 1, -1, -1):
            c = symbols[starts[live] + k]
            lo[live] = self.less[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.less[c] + self.matrix.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes: steps back to a sampled one."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        go = np.flatnonzero(~self.sampled[rows])
        while len(go):
            symbol, rank = self.matrix.access_and_rank(rows[go])
            rows[go] = self.less[symbol] + rank
            steps[go] += 1
            go = go[~self.sampled[rows[go]]]
        return self.samples[self.order[rows]] + steps


class Phrases:
    """The windows of some benchmark items: the items' words as symbols in one array, where each window begins in
    it, and of which item it is. Some 30 bytes a word, whatever the overlap of windows."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        data, offsets = raw_bytes(texts)
        data = LOWER[data]
        is_word = IS_WORD[data]
        starts, stops, row = word_bounds(is_word, offsets)
        pick, word = exact_groups(span_hashes(data, is_word, starts, stops), data, starts, stops - starts)
        # the vocabulary: every word once with its bytes, in order of its hash
        hashes = span_hashes(data, is_word, starts, stops)[pick]
        order = np.argsort(hashes, kind="stable")
        place = np.zeros(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.hashes = hashes[order]
        self.size = (stops - starts)[pick][order]
        self.at = np.cumsum(self.size) - self.size
        self.words = data[np.arange(int(self.size.sum())) - np.repeat(self.at - starts[pick][order], self.size)]
        self.symbols = place[word] + np.int32(1)
        self.ids = np.array(ids, object)
        count = np.bincount(row, minlength=len(ids))
        first = np.cumsum(count) - count
        size = np.minimum(count, window)
        n = np.where(count > 0, count - size + 1, 0)
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), n)
        begin = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)).astype(np.int32)
        self.by_size = {int(k): (begin[size[owner] == k], owner[size[owner] == k]) for k in np.unique(size[owner])}

    def known(self, data: np.ndarray, is_word: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The symbol of every word, 0 for those that no item has: by hash, then by the bytes."""
        out = np.zeros(len(starts), np.int64)
        if not len(self.hashes):
            return out
        h = span_hashes(data, is_word, starts, stops)
        at = np.searchsorted(self.hashes, h)
        todo = np.flatnonzero((at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h))
        while len(todo):  # more than once only where two words of the vocabulary share a hash
            k = at[todo]
            same = self.size[k] == (stops - starts)[todo]
            same[same] = same_spans(data, starts[todo[same]], self.words, self.at[k[same]], self.size[k[same]])
            out[todo[same]] = k[same] + 1
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < len(self.hashes)]
            todo = todo[self.hashes[at[todo]] == h[todo]]
        return out

    def hits(self, data: np.ndarray, is_word: np.ndarray, starts: np.ndarray, stops: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """First and last word of every occurrence, and the items found in each row."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), {}
        if not self.by_size or not len(starts):
            return none
        symbol = self.known(data, is_word, starts, stops)
        known = symbol > 0
        if not known.any():
            return none
        # runs of known words in one row, long enough for the shortest window
        begins = known.copy()
        begins[1:] &= ~(known[:-1] & (row[1:] == row[:-1]))
        run = np.cumsum(begins) - 1
        size = np.bincount(run[known], minlength=int(begins.sum()))
        keep = np.flatnonzero(known & (size[np.maximum(run, 0)] >= min(self.by_size)))
        if not len(keep):
            return none
        opens = np.r_[True, run[keep][1:] != run[keep][:-1]]
        place = np.arange(len(keep)) + np.cumsum(opens)  # a separator goes before every run
        text = np.zeros(int(place[-1]) + 2, np.int64)
        text[place] = symbol[keep]
        word_at = np.zeros(len(text), np.int64)
        word_at[place] = keep
        index = FMIndex(text, len(self.hashes) + 1)
        first, last = [], []
        items: dict[int, set[str]] = {}
        for size, (begin, owner) in self.by_size.items():
            for low in range(0, len(begin), 1 << 18):
                lo, hi = index.search(self.symbols, begin[low : low + (1 << 18)], size)
                some = np.flatnonzero(hi > lo)
                for a in range(0, len(some), 4096):
                    part = some[a : a + 4096]
                    n = hi[part] - lo[part]
                    rows = np.repeat(lo[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    w = word_at[index.locate(rows)]
                    first.append(w)
                    last.append(w + size - 1)
                    pair = np.unique(np.repeat(owner[low + part].astype(np.int64), n) * (int(row[-1]) + 1) + row[w])
                    for p, r in zip((pair // (int(row[-1]) + 1)).tolist(), (pair % (int(row[-1]) + 1)).tolist(), strict=True):
                        items.setdefault(r, set()).add(self.ids[p])
        return (np.concatenate(first), np.concatenate(last), items) if first else none


def _scanned(blocks: list, again: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, SHARD_BYTES):
            raw, offsets = raw_bytes(chunk.column("text"))
            n = len(offsets) - 1
            data = LOWER[raw]
            is_word = IS_WORD[data]
            starts, stops, row = word_bounds(is_word, offsets)
            step = np.zeros(len(starts) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(n)]
            if again:
                items = [set(x or ()) for x in chunk.column("items").to_pylist()]
                spans = chunk.column("spans").combine_chunks()
                per = np.diff(np.asarray(spans.offsets))
                low = np.repeat(offsets[:-1], per)
                old = spans.flatten()
                for name, way, column in (("begin", 1, starts), ("end", -1, stops)):
                    at = np.searchsorted(column, np.asarray(old.field(name)) + low)
                    np.add.at(step, at + (way < 0), way)
            for block in blocks:
                first, last, more = block.value.hits(data, is_word, starts, stops, row)
                np.add.at(step, first, 1)
                np.add.at(step, last + 1, -1)
                for r, own in more.items():
                    items[r] |= own
            hit = np.cumsum(step)[:-1] > 0
            begins = hit.copy()
            begins[1:] &= ~(hit[:-1] & (row[1:] == row[:-1]))
            ends = hit.copy()
            ends[:-1] &= ~(hit[1:] & (row[1:] == row[:-1]))
            b, e = np.flatnonzero(begins), np.flatnonzero(ends)
            per_row = np.bincount(row[b], minlength=n)
            spans = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(per_row)].astype(np.int32)),
                pa.StructArray.from_arrays([pa.array((starts[b] - offsets[row[b]]).astype(np.int32)), pa.array((stops[e] - offsets[row[b]]).astype(np.int32))], ["begin", "end"]),
            )
            yield pa.record_batch({
                "doc_id": chunk.column("doc_id").combine_chunks(),
                "text": chunk.column("text").combine_chunks(),
                "n_words": pa.array(np.bincount(row, minlength=n)),
                "n_hit": pa.array(np.bincount(row[hit], minlength=n)),
                "spans": spans,
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                **({"carried": chunk.column("carried").combine_chunks()} if "carried" in chunk.column_names else {}),
            })

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = 4 << 20, blocks_a_pass: int = 2, carry: list[str] = ()) -> DataFrame:
    """(doc_id, text, n_words, n_hit, spans, items, carried) for every row of docs.

    carried: a struct of the row's columns named in ``carry`` (absent if none are).

    Words are runs of digits, a-z (A-Z become lower case) and code points from 0x80. A window
    is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. spans: merged byte ranges of the text that windows cover; n_hit: words in them;
    items: names of the items with a window in the text, sorted as strings. Null texts have
    no words; items with a null name or no words are none; repeated items count once.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("item_text")).where("item IS NOT NULL AND item_text IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    count = int(total // block_bytes) + 1
    rows = carrying(docs, id_col, text_col, carry)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, n_words long, n_hit long, spans {SPANS}, items array<string>{carried_type(rows)}"
    numbered = bench.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(count)))
    for begin in range(0, count, blocks_a_pass):
        blocks = []
        for k in range(begin, min(count, begin + blocks_a_pass)):
            table = numbered.where(F.col("block") == k).select("item", "item_text").toArrow()
            blocks.append(spark.sparkContext.broadcast(Phrases(table.column(0).to_pylist(), table.column(1).combine_chunks(), window)))
        rows = rows.mapInArrow(_scanned(blocks, begin > 0), schema)
        if begin + blocks_a_pass < count:
            rows = staged(rows, "contamination")
    return rows


def contaminated():
    """The contract's rule: some words hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_OP10 = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS s FROM bw, UNNEST(range(1, len(w) - least(13, len(w)) + 2)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
dp AS (SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS s FROM dw, sizes, UNNEST(range(1, len(w) - size + 2)) AS u(k) WHERE len(w) >= size),
hit AS (SELECT dp.doc_id, dp.k, dp.size, win.item FROM dp JOIN win ON win.size = dp.size AND win.s = dp.s),
hw AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hit, UNNEST(range(size)) AS u(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw ON hw.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""

QUERIES = {"op10_benchmark_decontamination": op10_benchmark_decontamination}
ORACLES = {"op10_benchmark_decontamination": ORACLE_OP10}
