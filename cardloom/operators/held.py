"""Texts with the first of many needles' rows that they meet, found where the texts are.

Each task holds the needles: hashes, a filter of bits, and their rows. A text is tried with each length of needles, by sums over
its characters; from the fourth character on only at places where a needle's first characters stand. So work for a text
doesn't depend on the number of needles, no text is shuffled and nothing is written. Hashes only propose: a needle that
settles a text is compared with it, the others' rows are tested by the caller's condition.

More needles than HELD bytes are gone through in blocks, one to a task, over the distinct texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields as f
from .containment import _Filter, _cut, _kind_hash, _mixed, _segments, CHARS, MOST_BITS, PER_KEY, U64

#: Bytes of needles and their rows that a task holds, some, and rows that it sends back at once.
HELD, SENT = 1 << 27, 1 << 17
#: The shortest beginning of needles that is looked for; then twice as long, and so on.
BEGINNING = 4

_BASE = 0xD6E8FEB86659FD93
_NONE = (1 << 32) - 1
_PREFIX = 1 << 40


class _Sums:
    """Hashes of runs of characters."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, self.down = (np.multiply.accumulate(np.r_[U64(1), np.full(n, U64(b), U64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.r_[U64(0), np.cumsum((codes + U64(1)) * up[:n], dtype=U64)]

    def of(self, at: np.ndarray, n: int, salt: int) -> np.ndarray:
        return _mixed((self.sums[at + n] - self.sums[at]) * self.down[at] ^ U64(salt))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)


class _Needles:
    """Needles to look for: ``rows``, in their order, each with its needle and whether that alone settles a text."""

    def __init__(self, rows: pa.StructArray, needles: list[str], sure: np.ndarray):
        self.rows = rows
        found = sorted(set(needles), key=lambda s: (len(s), s))
        place = {s: k for k, s in enumerate(found)}
        own = np.array([place[s] for s in needles], np.int64)
        lens = np.array([len(s) for s in found], np.int64)
        self.longest = int(lens[-1])
        self.levels = {BEGINNING << k for k in range(self.longest.bit_length()) if BEGINNING << k < self.longest}
        self.steps = sorted(self.levels.union(lens.tolist()))
        for self.salt in range(64):  # until no two needles share a hash
            h, firsts = self._hashes(found, lens)
            self.ids = np.argsort(h)
            self.hashes = h[self.ids]
            if not (self.hashes[1:] == self.hashes[:-1]).any():
                break
        else:
            raise ValueError("needles that hashes don't tell apart")
        self.filter = _filter(np.concatenate([h, firsts]))
        self.needles = pa.array(found, pa.large_string())
        at = np.arange(len(own))
        self.pairs = np.sort(own << 32 | at)
        self.starts = np.searchsorted(self.pairs, np.arange(len(found)) << 32)
        self.sure = np.full(len(found), _NONE, np.int64)
        np.minimum.at(self.sure, own[sure], at[sure])

    def _hashes(self, found: list[str], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the needles, by length, and of the beginnings of longer ones."""
        whole, firsts = [], []
        part = (np.cumsum(lens) - lens) // CHARS
        for a, b in zip(*[np.searchsorted(part, np.unique(part), side=s) for s in ("left", "right")], strict=True):
            sums, own = _Sums(_codes("".join(found[a:b]))), lens[a:b]
            begins = np.cumsum(own) - own
            whole += [_kind_hash(sums.of(begins[own == n], n, self.salt), int(n)) for n in np.unique(own)]
            firsts += [np.unique(_kind_hash(sums.of(begins[own > n], n, self.salt), n + _PREFIX)) for n in self.levels]
        return np.concatenate(whole), np.unique(np.concatenate([np.zeros(0, U64), *firsts]))

    def among(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, needle): needles that are probably in the texts, each once."""
        out = [np.zeros(0, np.int64)]
        for held in _segments(texts, self.longest - 1):
            codes = _codes("".join(s for _, _, s in held))
            ends = np.cumsum([len(s) for _, _, s in held])
            rows = np.array([r for r, _, _ in held], np.int64)
            sums = _Sums(codes)
            live = np.arange(len(codes))
            end = np.repeat(ends, np.diff(ends, prepend=0))
            for n in self.steps:
                live = live[live + n <= end[live]]
                h = sums.of(live, n, self.salt)
                own = _kind_hash(h, n)
                hit = self.filter.places(own)
                k = np.minimum(np.searchsorted(self.hashes, own[hit]), len(self.hashes) - 1)
                same = self.hashes[k] == own[hit]
                out.append(np.unique(rows[np.searchsorted(ends, live[hit[same]], side="right")] << 32 | self.ids[k[same]]))
                if n in self.levels:
                    live = live[self.filter.places(_kind_hash(h, n + _PREFIX))]
        both = np.unique(np.concatenate(out))
        return both >> 32, both & _NONE

    def met(self, texts: list[str]) -> Iterator[pa.ListArray]:
        """For each text the rows of its needles in their order, up to the first that settles it; some SENT at once."""
        text, needle = self.among(texts)
        while True:
            best = np.full(len(texts), _NONE, np.int64)
            np.minimum.at(best, text, self.sure[needle])
            settles = np.flatnonzero((self.sure[needle] == best[text]) & (best[text] < _NONE))
            found = self.needles.take(pa.array(needle[settles])).to_pylist()
            wrong = [s for s, t, word in zip(settles.tolist(), text[settles].tolist(), found, strict=True) if word not in texts[t]]
            if not wrong:
                break
            text, needle = np.delete(text, wrong), np.delete(needle, wrong)
        first = self.starts[needle]
        many = np.searchsorted(self.pairs, needle << 32 | best[text], side="right") - first
        ends = np.cumsum(np.bincount(text, many, len(texts)).astype(np.int64))
        a = 0
        while a < len(texts):
            sent = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, sent + SENT, side="right")))
            lo, hi = np.searchsorted(text, (a, b))
            n = many[lo:hi]
            at = np.repeat(first[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows = np.sort(np.repeat(text[lo:hi], n) << 32 | self.pairs[at] & _NONE) & _NONE
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, ends[a:b] - sent].astype(np.int32)), self.rows.take(pa.array(rows)))
            a = b


def _filter(h: np.ndarray) -> _Filter:
    bits = min(MOST_BITS, max(16, (PER_KEY * len(h) - 1).bit_length()))
    table = np.zeros(1 << (bits - 6), U64)
    for shift in (0, 64 - bits):
        at = (h >> U64(shift)) & U64((1 << bits) - 1)
        np.bitwise_or.at(table, (at >> U64(6)).view(np.int64), U64(1) << (at & U64(63)))
    return _Filter(table, bits)


def _tried(needles: DataFrame, needle: str, names: list[str], sure: str):
    """A function of a column of texts: the rows (``names``) of the needles that each meets. None without needles."""
    held = needles.orderBy(*names).toArrow()
    if not held.num_rows:
        return None
    rows = held.select(names).combine_chunks().to_struct_array().combine_chunks()
    table = needles.sparkSession.sparkContext.broadcast(_Needles(rows, held.column(needle).to_pylist(), np.array(held.column(sure).to_pylist(), bool)))

    @F.arrow_udf(T.ArrayType(T.StructType([needles.schema[c] for c in names])))
    def met(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in _cut(pa.record_batch({"_text": t}) for t in texts):
            yield from table.value.met([t or "" for t in part.column(0).to_pylist()])

    return met


def pairs(texts: DataFrame, text: str, needles: DataFrame, needle: str, order: str, sure: str, test: Callable[[Column, Column], Column]) -> DataFrame:
    """texts with the column ``order`` of the smallest row of ``needles`` whose needle the text contains and for which ``test``
    (text, row) holds; null without one, or without a text.

    Columns of needles: the needle, ``order`` (never null), ``sure`` (that test holds wherever the needle is contained: later rows need no test)
    and what test reads. Null and empty needles are contained in nothing. Comparison is by code points.
    """
    wanted = needles.where(F.col(needle) != "")
    names = [order, *[c for c in needles.columns if c not in (order, needle, sure)]]
    size = wanted.agg(F.sum(F.octet_length(needle) + F.octet_length(F.to_json(F.struct(*names))) + 64)).first()[0]
    if not size:
        return texts.withColumn(order, F.lit(None).cast(needles.schema[order].dataType))
    n = -(-size // HELD)
    blocks = [b for b in (_tried(wanted.where(F.pmod(F.xxhash64(needle), F.lit(n)) == k), needle, names, sure) for k in range(n)) if b]

    def best(rows: DataFrame, met) -> DataFrame:
        passed = F.filter(met(F.col(text)), lambda x: test(F.col(text), x))
        return f.computed(rows, {order: F.array_min(F.transform(passed, lambda x: x[order]))})

    if len(blocks) == 1:
        return best(texts, blocks[0])
    once = texts.where(F.col(text).isNotNull()).select(text).distinct()
    found = reduce(DataFrame.unionByName, [best(once, b).where(F.col(order).isNotNull()) for b in blocks])
    return texts.join(found.groupBy(text).agg(F.min(order).alias(order)), text, "left")
