"""Byte-level BPE vocabulary files and vectorised pre-splitting of texts into pieces.

A piece is what the split pattern of byte-level BPE matches: a contraction, a run of
letters, of digits or of other signs, each with one space before it, or white space.
Pieces are found by comparing neighbouring code points' classes in numpy, hashed, and
looked up in a bounded direct-mapped cache, where their code points are compared; only pieces
that the cache doesn't hold are encoded one by one.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

from .common import U64, exact_groups, kept, mixed, same_spans, span_sums

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0


def classes() -> np.ndarray:
    """The class of every code point."""
    return kept("code point classes", _code_point_classes)


def _code_point_classes() -> np.ndarray:
    table = np.zeros(0x110000, np.int8)
    for low in range(0, 0x110000, 0x1000):
        if 0xD800 <= low < 0xE000:
            continue  # surrogates
        block = "".join(map(chr, range(low, low + 0x1000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, block):
                table[low + m.start() : low + m.end()] = kind
    # regex may know a newer Unicode than the tokenizers library: ask that about young code points
    young = [c for c in np.flatnonzero(table).tolist() if unicodedata.category(chr(c)) == "Cn"]
    splitter = ByteLevel(add_prefix_space=False)
    for lead, kind in (("a", LETTER), ("1", DIGIT)):
        own = [c for c in young if table[c] == kind]
        starts = {a for _, (a, _) in splitter.pre_tokenize_str("".join(f"\n{lead}{chr(c)}" for c in own))}
        table[[c for k, c in enumerate(own) if 3 * k + 2 in starts]] = OTHER
    return table


def piece_starts(points: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """For each code point, whether a piece starts there; row_starts: where rows (never empty) start."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n, bool)
    first[row_starts] = True
    last = np.zeros(n, bool)
    last[row_starts[1:] - 1] = True
    if n:
        last[-1] = True
    before = np.r_[np.int8(-1), kind[:-1]]
    before[first] = -1
    after = np.r_[kind[1:], np.int8(-1)]
    after[last] = -1
    space = kind == SPACE
    plain = points == 0x20
    # the last white space before a sign stands alone or, if it is a blank, leads the next piece
    ends_run = space & (after != SPACE) & (after != -1)
    leads = np.zeros(n, bool)
    leads[1:] = (ends_run & plain)[:-1]
    leads[first] = False
    start = first | (space & (before != SPACE)) | ends_run | (~space & (kind != before) & ~leads)
    # contractions: an apostrophe that starts a piece, then s t m d or re ve ll
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        at = lambda k: np.where((quote + k < n) & ~first[np.minimum(quote + k, n - 1)], points[np.minimum(quote + k, n - 1)], 0)
        a = at(1)
        b = np.where(a > 0, at(2), 0)
        one = np.isin(a, [0x73, 0x74, 0x6D, 0x64])
        two = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        for hit, size in ((one, 2), (two, 3)):
            q = quote[hit]
            start[q + 1] = False
            nxt = q + size
            nxt = nxt[nxt < n]
            # what follows starts anew, but for a blank's follower it already does
            letters = nxt[(kind[nxt] == LETTER) & ~first[nxt]]
            start[letters] = True
    return start


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: labels, merges in order, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or model.get("dropout") or odd:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        letters = _byte_letters()
        self.label = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label |= {i: t.encode() for t, i in self.added.items()}


class PieceEncoder:
    """Texts to token ids; ``encode`` gives the ids of unseen pieces: list of str -> (all ids, number of ids of each).

    A seen piece is found by its hash and compared with its bytes kept beside it, so a chance
    collision costs a second encoding and never a wrong id. Slots and pools are of fixed size;
    pieces of over 255 bytes are not kept.
    """

    def __init__(self, added: dict[str, int], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], slots: int = 1 << 21, pool: int = 5_000_000):
        self.added, self.encode, self.slots, self.pool_limit = added, encode, slots, pool
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(self.slots, U64)
        self.at = np.zeros(self.slots, np.int32)  # of its ids in the pool
        self.size = np.zeros(self.slots, np.uint8)
        self.text_at = np.zeros(self.slots, np.int32)  # of its bytes
        self.text_size = np.zeros(self.slots, np.uint8)  # 0: a free slot
        self.pool = np.zeros(self.pool_limit, np.int32)
        self.texts = np.zeros(3 * self.pool_limit, np.uint8)
        self.used = self.text_used = 0

    def _keep(self, key: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Enter pieces with their ids; if the pools are full, start over with these alone, as far as they fit."""
        short = size < 256  # a byte has one id at most
        if not short.all():
            ids = ids[np.repeat(short, n_ids)]
            key, n_ids, begin, size = key[short], n_ids[short], begin[short], size[short]
        if self.used + len(ids) > len(self.pool) or self.text_used + int(size.sum()) > len(self.texts):
            self.reset()
            fit = (np.cumsum(n_ids) <= len(self.pool)) & (np.cumsum(size) <= len(self.texts))
            key, n_ids, begin, size = key[fit], n_ids[fit], begin[fit], size[fit]
            ids = ids[: int(n_ids.sum())]
        place, text_place = self.used + np.cumsum(n_ids) - n_ids, self.text_used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(ids)] = ids
        self.texts[self.text_used : self.text_used + int(size.sum())] = data[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - begin, size)]
        self.used += len(ids)
        self.text_used += int(size.sum())
        to = (key & U64(self.slots - 1)).astype(np.int64)
        self.key[to], self.at[to], self.size[to], self.text_at[to], self.text_size[to] = key, place, n_ids, text_place, size

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        rows, special = texts, None
        owner = None
        if self.split and any(t in x for x in texts for t in self.added):
            parts = [[p for p in self.split.split(x) if p] for x in texts]
            owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
            rows = [p for x in parts for p in x]
            special = np.array([p in self.added for p in rows], bool)
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        whole = "".join(rows)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        filled = lens > 0
        row_at = (np.cumsum(lens) - lens)[filled]
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        start = piece_starts(points, row_at)
        if special is not None:
            for r in np.flatnonzero(special[filled]):
                start[row_at[r] + 1 : row_at[r] + lens[filled][r]] = False
        begin = np.flatnonzero(start)
        size = np.diff(np.r_[begin, len(points)])
        value = (points.astype(U64) + U64(0x51ED270B)) * U64(0xD6E8FEB86659FD93)
        value ^= value >> U64(32)
        h = mixed(span_sums(value, begin, size) + size.astype(U64))
        del value
        slot = (h & U64(self.slots - 1)).astype(np.int64)
        data = np.frombuffer(whole.encode(), np.uint8)
        wide = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)) if len(data) > len(points) else None
        at = begin if wide is None else np.r_[0, wide[begin[1:] - 1]]  # of each piece's bytes
        long = np.diff(np.r_[at, len(data)])
        hit = (self.key[slot] == h) & (self.text_size[slot] == long)
        hit[hit] = same_spans(data, at[hit], self.texts, self.text_at[slot[hit]], long[hit])
        count = np.where(hit, self.size[slot], 0).astype(np.int64)
        known = self.pool[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - self.at[slot], count)]
        out = known
        miss = np.flatnonzero(~hit)
        if len(miss):
            pick, back = exact_groups(h[miss], data, at[miss], long[miss])
            first = miss[pick]
            ids, n_ids = self.encode([whole[i : i + k] for i, k in zip(begin[first].tolist(), size[first].tolist(), strict=True)])
            count[miss] = n_ids[back]
            to = np.cumsum(count) - count
            out = np.zeros(int(count.sum()), np.int32)
            fresh = np.zeros(len(out), bool)
            n = count[miss]
            run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            place = run + np.repeat(to[miss], n)
            fresh[place] = True
            out[place] = ids[run + np.repeat((np.cumsum(n_ids) - n_ids)[back], n)]
            out[~fresh] = known
            self._keep(h[first], ids, n_ids, data, at[first], long[first])
        per_row = np.zeros(len(rows), np.int64)
        row_of_piece = np.searchsorted(row_at, begin, side="right") - 1
        per_row[np.flatnonzero(filled)] = np.bincount(row_of_piece, weights=count, minlength=len(row_at)).astype(np.int64)
        if owner is not None:
            per_row = np.bincount(owner, weights=per_row, minlength=len(texts)).astype(np.int64)
        return out, per_row
