"""Language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts of up to ``order`` bytes, trained on all training rows.
A symbol's probability in a context: its count less a half over the context's total, or an
escape with half the number of distinct followers to the context one byte shorter, where the
symbols just ruled out are excluded (escape method D, full counts); below order 0 all symbols
not yet seen are equally likely. The text that is scored is the token
sequence: lower-cased words, one space between them, an end symbol after the last.

The trie is never in one place. Documents are dealt into blocks of some MB. A block's
distinct (context, symbol) paths and words go, with their training counts, to buckets: a
path by the hash of its last three context bytes, so that a bucket has whole subtrees of the
trie of reversed contexts; under a context of three bytes that is very frequent, by the last
four, and the counts of that context itself are broadcast. The bucket sums counts, computes the code length of every path
asked for, and answers each block; only the trie's top (contexts of two bytes at most, so at
most 2 ** 24 counts whatever the corpus) is broadcast. The block then adds up its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_a_task, IS_SPACE, LOWER, PACKED, U64, exchanged, mixed, partitions, raw_bytes, runs, small_batches, span_hashes, staged, text_chunks, tidy, word_bounds

ORDER = 5
END, PAD = 0xFE, 0xFF
SYMBOLS = 255  # every byte but PAD; END is no byte of UTF-8
ALPHA = 0.1
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20  # of text whose paths and words one bucket sums up
HOT_COUNT = 16_000_000  # occurrences of a context of three bytes from which on one bucket doesn't take it whole
SLICE_BYTES = 1 << 20  # of a block's text handled at once


def normal_form(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all rows (ORDER pads, words and spaces, end), where each row starts, and the words' hashes and rows."""
    data, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    data = LOWER[data]
    is_word = ~IS_SPACE[data]
    starts, stops, row = word_bounds(is_word, offsets)
    size = stops - starts + 1
    count = np.bincount(row, minlength=n)
    bytes_of = np.bincount(row, weights=size, minlength=n).astype(np.int64)
    row_size = ORDER + np.where(count > 0, bytes_of, 1)
    row_at = np.cumsum(row_size) - row_size
    inside = np.cumsum(size) - size - (np.cumsum(bytes_of) - bytes_of)[row]
    at = row_at[row] + ORDER + inside
    out = np.full(int(row_size.sum()), 0x20, np.uint8)
    plain = np.ones(len(out), bool)
    plain[at + size - 1] = False
    ends = row_at + row_size - 1
    plain[ends] = False
    for k in range(ORDER):
        plain[row_at + k] = False
        out[row_at + k] = PAD
    out[plain] = data[is_word]
    out[ends] = END
    return out, row_at, span_hashes(data, is_word, starts, stops), row


def paths(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol at every place but the pads, the latest context byte highest and the symbol lowest; the places."""
    at = np.flatnonzero(out != PAD)
    wide = out.astype(U64)
    key = wide[at]
    for k in range(1, ORDER + 1):
        key |= wide[at - k] << U64(8 * (ORDER + 1 - k))
    return key, at


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.r_[new, len(keys)])


def distinct(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, each once."""
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def placed(universe: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of all of universe (sorted), of which keys is a part."""
    out = np.zeros(len(universe), np.int64)
    out[np.searchsorted(universe, keys)] = counts
    return out


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Level:
    """Contexts of one length: followers and counts, and per context total, followers and what they add up to one byte shorter."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shorter: Level | None):
        self.keys, self.counts = keys, counts
        ctx = keys >> U64(8)
        cuts = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, np.int64)
        self.contexts = ctx[cuts]
        self.total = np.add.reduceat(counts, cuts) if len(cuts) else np.zeros(0, np.int64)
        self.followers = np.diff(np.r_[cuts, len(ctx)])
        self.ruled_out = np.zeros(len(cuts), np.int64)
        if shorter is not None and len(cuts):
            at, _ = found(shorter.keys, ((ctx >> U64(8)) << U64(8)) | (keys & U64(255)))
            self.ruled_out = np.add.reduceat(shorter.counts[at], cuts)


def levels_of(keys: np.ndarray, counts: np.ndarray, length: int, lengths: range, below: dict[int, Level]) -> dict[int, Level]:
    """Levels for context lengths in ``lengths`` (ascending) from paths with contexts of ``length`` bytes.

    A context is kept latest byte highest, so the shorter one is its high part.
    """
    out = dict(below)
    for k in lengths:
        short = ((keys >> U64(8 * (length + 1 - k))) << U64(8)) | (keys & U64(255))
        order = np.argsort(short, kind="stable")
        s, c = short[order], counts[order]
        cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        out[k] = Level(s[cuts], np.add.reduceat(c, cuts) if len(cuts) else c, out.get(k - 1))
    return out


def code_lengths(asked: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of the symbol of every path."""
    out = np.zeros(len(asked))
    todo = np.arange(len(asked))
    gone_total = np.zeros(len(asked), np.int64)
    gone_followers = np.zeros(len(asked), np.int64)
    for k in range(ORDER, -1, -1):
        level = levels[k]
        key = ((asked[todo] >> U64(8 * (ORDER + 1 - k))) << U64(8)) | (asked[todo] & U64(255))
        c, known = found(level.contexts, key >> U64(8))
        e, seen = found(level.keys, key)
        if len(level.contexts):
            total = level.total[c] - gone_total[todo]
            followers = level.followers[c] - gone_followers[todo]
            room = np.maximum(2 * total, 1).astype(float)
            if len(level.keys):
                hit = todo[seen]
                out[hit] += np.log10((2 * level.counts[e[seen]] - 1) / room[seen])
            away = known & ~seen & (followers > 0)
            out[todo[away]] += np.log10(followers[away] / room[away])
            gone_total[todo[known]] = level.ruled_out[c[known]]
            gone_followers[todo[known]] = level.followers[c[known]]
        todo = todo[~seen]
    if len(todo):
        zero = levels[0]
        out[todo] -= np.log10(SYMBOLS - (int(zero.followers[0]) if len(zero.followers) else 0))
    return out


@tidy
def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of paths with two context bytes, and under -1 and -2 the training words and rows."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = rows = 0
    for chunk in text_chunks(batches):
        out, row_at, _, row = normal_form(chunk.column("text"))
        words += len(row)
        rows += len(row_at)
        at = np.flatnonzero(out != PAD)
        wide = out.astype(np.uint32)
        k, c = counted((wide[at - 1] << 16) | (wide[at - 2] << 8) | wide[at])
        both = np.concatenate([keys, k.astype(np.int64)])
        order = np.argsort(both, kind="stable")
        both, total = both[order], np.concatenate([counts, c])[order]
        cuts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        keys, counts = both[cuts], np.add.reduceat(total, cuts)
    yield pa.record_batch({"key": pa.array(np.r_[keys, -1, -2].astype(np.int64)), "count": pa.array(np.r_[counts, words, rows].astype(np.int64))})


def _below(hot: np.ndarray):
    """Training counts of paths whose context is one of the hot ones (three bytes, latest highest, sorted)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for chunk in text_chunks(batches):
            out, _, _, _ = normal_form(chunk.column("text"))
            at = np.flatnonzero(out != PAD)
            wide = out.astype(U64)
            ctx = (wide[at - 1] << U64(16)) | (wide[at - 2] << U64(8)) | wide[at - 3]
            own = found(hot, ctx)[1]
            k, c = counted((ctx[own] << U64(8)) | wide[at[own]])
            both, total, _ = _summed([keys[0], k], [counts[0], c])
            keys, counts = [both], [total]
        yield pa.record_batch({"key": pa.array(keys[0].astype(np.int64)), "count": pa.array(counts[0])})

    return run


def _bucket(keys: np.ndarray, drop: int, buckets: int, hot: np.ndarray = np.zeros(0, U64)) -> np.ndarray:  # noqa: B008
    dealt_by = keys >> U64(drop)
    if len(hot):  # one byte more decides under hot contexts
        wide = found(hot, dealt_by)[1]
        dealt_by = np.where(wide, (keys >> U64(drop - 8)) | U64(1 << 40), dealt_by)
    return ((mixed(dealt_by + U64(1)) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _dealt(keys: np.ndarray, drop: int, buckets: int, hot: np.ndarray = np.zeros(0, U64)) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """The order that puts keys bucket by bucket, and where each bucket begins."""
    bucket = _bucket(keys, drop, buckets, hot)
    return np.argsort(bucket, kind="stable"), np.searchsorted(np.sort(bucket), np.arange(buckets + 1))


WORD_DROP, PATH_DROP = 0, 8 * (ORDER - 2)  # a path is dealt by its last three context bytes


def _asked(buckets: int, hot: np.ndarray):
    @tidy
    def run(table: pa.Table) -> pa.Table:
        lists: tuple[list, list] = ([], [])
        for chunk in text_chunks(table.to_batches(), SLICE_BYTES):
            train = np.asarray(chunk.column("train").combine_chunks())
            out, row_at, word, row = normal_form(chunk.column("text"))
            key, at = paths(out)
            for side, keys, mine in ((0, word, train[row]), (1, key, train[np.searchsorted(row_at, at, side="right") - 1])):
                universe, n = counted(keys)
                lists[side].append((universe, n if mine.all() else placed(universe, *counted(keys[mine]))))
        sides = []
        for parts, drop in zip(lists, (WORD_DROP, PATH_DROP), strict=True):
            universe, n, _ = _summed([u for u, _ in parts], [n for _, n in parts])
            order, cuts = _dealt(universe, drop, buckets, hot if drop else hot[:0])
            sides.append((universe[order], n[order].astype("<u4"), cuts))
        (w, wn, wc), (p, pn, pcut) = sides
        payload, bucket = [], []
        for b in range(buckets):
            x, y = slice(wc[b], wc[b + 1]), slice(pcut[b], pcut[b + 1])
            if x.stop > x.start or y.stop > y.start:
                bucket.append(b)
                payload.append(np.array([x.stop - x.start], "<u8").tobytes() + w[x].tobytes() + wn[x].tobytes() + p[y].tobytes() + pn[y].tobytes())
        block = np.full(len(bucket), table.column("block")[0].as_py() if table.num_rows else 0)
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "tag": pa.array(block, pa.int64()), "payload": pa.array(payload, pa.binary())})

    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and where each input is among them."""
    whole = np.concatenate(keys) if keys else np.zeros(0, U64)
    uniq, back = np.unique(whole, return_inverse=True)
    return uniq, np.bincount(back, weights=np.concatenate(counts) if counts else None, minlength=len(uniq)).astype(np.int64), back


def _answers(top):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = None
        for bucket, table in runs(batches):
            if low is None:
                keys, counts, hot_keys, hot_counts = top.value
                low = levels_of(keys, counts, 2, range(3), {})
            w, wn, p, pn, sizes = [], [], [], [], []
            for blob in table.column("payload").to_pylist():
                n = int(np.frombuffer(blob, "<u8", 1)[0])
                m = (len(blob) - 8 - 12 * n) // 12
                w.append(np.frombuffer(blob, "<u8", n, 8))
                wn.append(np.frombuffer(blob, "<u4", n, 8 + 8 * n))
                p.append(np.frombuffer(blob, "<u8", m, 8 + 12 * n))
                pn.append(np.frombuffer(blob, "<u4", m, 8 + 12 * n + 8 * m))
                sizes.append((n, m))
            words, count, back = _summed(w, wn)
            known = int((count > 0).sum())
            of_word = count[back].astype("<u8")
            path, count, back = _summed(p, pn)
            seen = count > 0
            levels = levels_of(path[seen], count[seen], ORDER, range(3, 4), low)
            if len(hot_keys):  # of hot contexts this bucket has a part only: the whole counts take its place
                own, cold = levels[3], ~found(distinct(hot_keys >> U64(8)), levels[3].keys >> U64(8))[1]
                both = np.concatenate([own.keys[cold], hot_keys])
                order = np.argsort(both)
                levels[3] = Level(both[order], np.concatenate([own.counts[cold], hot_counts])[order], low[2])
            levels = levels_of(path[seen], count[seen], ORDER, range(4, ORDER + 1), levels)
            of_path = code_lengths(path, levels)[back].astype("<f4")
            cut_w, cut_p = np.cumsum([0, *(n for n, _ in sizes)]), np.cumsum([0, *(m for _, m in sizes)])
            payload = [np.array([n], "<u8").tobytes() + of_word[a : a + n].tobytes() + of_path[b : b + m].tobytes() for (n, m), a, b in zip(sizes, cut_w, cut_p, strict=False)]
            yield pa.record_batch({
                "block": table.column("tag").combine_chunks(),
                "bucket": pa.array(np.full(len(sizes), bucket, np.int32)),
                "known": pa.array(np.r_[known, np.zeros(len(sizes) - 1, np.int64)].astype(np.int64)),  # counted once for all blocks
                "payload": pa.array(payload, pa.binary()),
            })

    return run


RESULT = "held_out boolean, n_tokens long, n_known long, part double, score double, known long"


def _added(buckets: int, hot: np.ndarray, train_rows: int, kind: pa.DataType):
    @tidy
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        own: list[np.ndarray] = [np.zeros(0, "<u8")] * buckets
        lens: list[np.ndarray] = [np.zeros(0, "<f4")] * buckets
        for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True):
            n = int(np.frombuffer(blob, "<u8", 1)[0])
            own[b] = np.frombuffer(blob, "<u8", n, 8)
            lens[b] = np.frombuffer(blob, "<f4", -1, 8 + 8 * n)
        n = docs.num_rows
        words, of_word, sorted_paths, firsts = [], [], [], [0]
        for chunk in text_chunks(docs.to_batches(), SLICE_BYTES):
            for a in range(0, chunk.num_rows, 1 << 16):  # rows whose number fits beside a path of 48 bits
                part = chunk.slice(a, 1 << 16)
                out, row_at, word, row = normal_form(part.column("text"))
                words.append(word)
                of_word.append(row + firsts[-1])
                key, at = paths(out)
                key <<= U64(16)
                key |= (np.searchsorted(row_at, at, side="right") - 1).astype(U64)
                key.sort()
                sorted_paths.append(key)
                firsts.append(firsts[-1] + part.num_rows)
        row = np.concatenate(of_word)
        uniq, back = np.unique(np.concatenate(words), return_inverse=True)
        order, _ = _dealt(uniq, WORD_DROP, buckets)
        count = np.zeros(len(uniq), np.int64)
        count[order] = np.concatenate(own)
        ends = train_rows > 0
        part = np.bincount(row, weights=np.log10(count + ALPHA)[back], minlength=n) + np.log10(train_rows + ALPHA)
        n_known = np.bincount(row, weights=(count > 0)[back], minlength=n).astype(np.int64) + int(ends)
        universe = np.unique(np.concatenate([distinct(x >> U64(16)) for x in sorted_paths]))
        order, _ = _dealt(universe, PATH_DROP, buckets, hot)
        length = np.zeros(len(universe))
        length[order] = np.concatenate(lens)
        score = np.zeros(n)
        for first, after, both in zip(firsts, firsts[1:], sorted_paths, strict=False):
            path = both >> U64(16)
            cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            value = np.repeat(length[np.searchsorted(universe, path[cuts])], np.diff(np.r_[cuts, len(path)]))
            score[first:after] = np.bincount((both & U64(0xFFFF)).astype(np.int64), weights=value, minlength=after - first)
        tokens = np.bincount(row, minlength=n) + 1
        known = sum(answers.column("known").to_pylist())
        return pa.table({
            "doc_id": pa.concat_arrays([docs.column("doc_id").combine_chunks().cast(kind), pa.nulls(1, kind)]),
            "held_out": pa.concat_arrays([pa.array(~np.asarray(docs.column("train").combine_chunks())), pa.nulls(1, pa.bool_())]),
            "n_tokens": pa.array(np.r_[tokens, 0].astype(np.int64)),
            "n_known": pa.array(np.r_[n_known, 0].astype(np.int64)),
            "part": pa.array(np.r_[part, 0.0]),
            "score": pa.array(np.r_[score, 0.0]),
            "known": pa.array([None] * n + [known], pa.int64()),
        })

    return run


def scored(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot_count: int = HOT_COUNT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    ``train``: boolean column of the rows to learn from (null: not); all of them are. Words are
    split at ASCII white space after A-Z became lower case; each row ends with one end token; a
    null or empty text is the end alone. base_score: add-0.1 unigram log10 probability of the
    tokens; score: the PPM model's log10 probability of the same sequence. Rows are independent,
    repeated ones too; without training rows all symbols are equally likely.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_task = buckets_a_task(spark, total, BUCKET_BYTES)
    buckets = partitions(spark) * per_task
    blocks = max(int(total // block_bytes) + 1, partitions(spark))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    table = rows.where("train").select("text").mapInArrow(_top, "key long, count long").groupBy("key").agg(F.sum("count").alias("count")).toArrow()
    keys, counts = (np.asarray(table.column(c).combine_chunks()) for c in ("key", "count"))
    train_words, train_rows = (int(counts[keys == k].sum()) for k in (-1, -2))
    order = np.argsort(keys)
    order = order[keys[order] >= 0]
    keys, counts = keys[order].astype(U64), counts[order]
    # a context of three bytes is as frequent as its last byte after the two before: at most corpus / hot_count are hot
    often = (counts > hot_count) & ((keys & U64(255)) != U64(END))
    hot = np.sort(((keys[often] & U64(255)) << U64(16)) | (keys[often] >> U64(8)))
    hot_keys, hot_counts = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(hot):
        table = rows.where("train").select("text").mapInArrow(_below(hot), "key long, count long").groupBy("key").agg(F.sum("count").alias("count")).toArrow()
        hot_keys, hot_counts = (np.asarray(table.column(c).combine_chunks()) for c in ("key", "count"))
        order = np.argsort(hot_keys)
        hot_keys, hot_counts = hot_keys[order].astype(U64), hot_counts[order]
    top = spark.sparkContext.broadcast((keys, counts, hot_keys, hot_counts))
    answers = exchanged(rows.groupBy("block").applyInArrow(_asked(buckets, hot), PACKED), per_task).mapInArrow(_answers(top), "block long, bucket int, known long, payload binary")
    id_type = rows.schema["doc_id"].dataType
    sums = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_added(buckets, hot, train_rows, to_arrow_type(id_type)), f"doc_id {id_type.simpleString()}, {RESULT}")
    sums = staged(sums, "lm-scores")
    distinct = (sums.agg(F.sum("known")).first()[0] or 0) + (train_rows > 0)
    n = train_words + train_rows
    floor = float(np.log10(n + ALPHA * (distinct + 1)))
    return sums.where("known IS NULL").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("part") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")


def op1_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)


QUERIES = {"op1_ppm_scores": op1_ppm_scores}
ORACLES: dict[str, str] = {}
