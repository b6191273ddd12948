"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: a state for each token, the one just read, and arcs for the tokens
that may follow. It is compiled by successive gadgets, one a merge, starting from the bytes, any
of which may follow any. The gadget of a merge (u, v) -> w, where u can still be followed by v,

* adds the state w, with the arcs that the state v has at that moment;
* takes the arc v from the state u;
* adds the arc w to every state that still has the arc u.

A merge whose parts no longer follow each other gets none, and its token is never read. The result
is deterministic and accepts, for each byte string, one sequence of tokens: that of the merges.

Arcs are numbered so that the table is small. A new arc w enters wherever u is, so an arc that is
gone takes with it all that would have entered through it later; with arcs numbered in postorder
of "enters through", siblings by age, an arc and all that it takes along are one interval. A state's row
is the list of intervals that it lacks: what its right part lacked when it was made, and one for each gadget that
took an arc from it. 50,000 merges make some 10^6 intervals, where 50,000 x 50,000 arcs would
be no table. A transition is a binary search in the row; labels are spelled by a byte trie in a hashed table, whose nodes have
failure links (the longest end of the node's bytes that is a node too) and links to the next shorter token that ends there.

Encoding takes one step a byte: on along the trie, over failure links where need be, and among the tokens that end
at the new node, from the longest down, the one that the state before it has an arc for. There is one such token
for each place, since the automaton is deterministic, so a place keeps one token, whatever the piece's length. Pre-split
pieces of equal length go through the tables together (numpy), few or long ones each alone; decoding emits the labels of the arcs.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_texts, kept, small_batches, text_chunks, tidy
from .presplit import PieceEncoder, Vocabulary


#: Pieces of one length that are worth a step of numpy for each byte.
TOGETHER = 32


class Arcs:
    """The compiled transitions: which arcs (tokens) each state (token) has."""

    def __init__(self, size: int, merges: list[tuple[int, int, int]]):
        self.size = size
        self.read = np.ones(size, bool)  # whether a token is ever read
        born, left, right = [-1] * size, [-1] * size, [-1] * size
        rows = [array("i") for _ in range(size)]  # gadgets whose taken arc each state lacks
        entering: list[list[int]] = [[] for _ in range(size)]  # arcs that entered through each, by age
        taken: dict[int, int] = {}  # state and arc: the gadget that took it
        older = np.zeros(len(merges), np.int64)  # arcs that had entered through the taken one by then
        for gadget, (u, v, w) in enumerate(merges):
            if born[w] >= 0 or not (self.read[u] and self.read[v]) or self._lost(taken, born, left, right, u, v):
                self.read[w] &= born[w] >= 0
                continue
            born[w], left[w], right[w] = gadget, u, v
            rows[w] = rows[v][:]
            older[gadget] = len(entering[v])
            taken[u * size + v] = gadget
            rows[u].append(gadget)
            entering[u].append(w)
        # postorder: an arc's interval ends with itself
        width = np.ones(size, np.int64)
        for _, _, w in reversed(merges):
            if born[w] >= 0:
                width[left[w]] += width[w]
        low = np.zeros(size, np.int64)
        roots = [i for i in range(size) if born[i] < 0]
        low[roots] = np.cumsum(width[roots]) - width[roots]
        begins: dict[int, list[int]] = {}  # where the intervals of the arcs that entered through each begin, and its own number
        for i in sorted((i for i in range(size) if entering[i]), key=lambda i: born[i]):
            at = [int(low[i])]
            for w in entering[i]:
                low[w] = at[-1]
                at.append(at[-1] + int(width[w]))
            begins[i] = at
        self.number = low + width - 1
        lost_from = np.array([(begins[v][older[k]] if v in begins else low[v]) if born[w] == k else 0 for k, (_, v, w) in enumerate(merges)], np.int64)
        lost_to = self.number[np.array([v for _, v, _ in merges], np.int64)] if merges else lost_from
        gadgets = np.concatenate([np.frombuffer(r, np.int32) for r in rows if len(r)] or [np.zeros(0, np.int32)])
        state = np.repeat(np.arange(size), [len(r) for r in rows])
        self.begin, self.end = state * size + lost_from[gadgets], state * size + lost_to[gadgets]
        order = np.argsort(self.end, kind="stable")
        # a gadget takes only an arc that is there, so a row's intervals are apart
        self.begin, self.end = np.r_[self.begin[order], size * size], np.r_[self.end[order], size * size]

    @staticmethod
    def _lost(taken: dict[int, int], born: list[int], left: list[int], right: list[int], u: int, v: int) -> bool:
        """Whether the state u lacks the arc v by now: whether a gadget took it, or an arc through which it
        would have entered, from u, or from a state whose arcs u got from before."""
        size, before = len(born), 1 << 60
        while u >= 0:
            arc, until = v, 1 << 60
            while arc >= 0:
                gadget = taken.get(u * size + arc)
                if gadget is not None and gadget < before and gadget <= until:
                    return True
                arc, until = left[arc], born[arc]
            u, before = right[u], born[u]
        return False

    def has(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.size + self.number[arc]
        return self.begin[np.searchsorted(self.end, key)] > key


class Automaton:
    def __init__(self, vocabulary: Vocabulary):
        self.added = vocabulary.added
        self.plain = None
        size = max(vocabulary.label) + 1
        self.size = size
        self.arcs = Arcs(size, vocabulary.merges)
        labels = [(vocabulary.label.get(i, b"")) for i in range(size)]
        self.label_at = np.cumsum([0, *map(len, labels)])
        self.labels = np.frombuffer(b"".join(labels), np.uint8)
        nodes: list[dict[int, int]] = [{}]
        token = [-1]
        added = set(self.added.values())
        for i, label in enumerate(labels):
            if not label or not self.arcs.read[i] or i in added:
                continue
            node = 0
            for b in label:
                node = nodes[node].setdefault(b, len(nodes))
                if node == len(nodes):
                    nodes.append({})
                    token.append(-1)
            token[node] = i
        self.token = np.array(token, np.int32)
        # by depth: a node's failure link is that of the node before it, taken on by the same byte
        fail = [0] * len(nodes)
        upper = [(0, b, n) for b, n in nodes[0].items()]
        shorter = [0] * len(nodes)  # the longest proper end of a node that is a token
        while upper:
            lower = []
            for parent, b, node in upper:
                link = fail[parent]
                while parent and link and b not in nodes[link]:
                    link = fail[link]
                link = nodes[link].get(b, 0) if parent else 0
                fail[node] = link
                shorter[node] = link if token[link] >= 0 else shorter[link]
                lower += [(node, c, n) for c, n in nodes[node].items()]
            upper = lower
        self.fail, self.shorter = np.array(fail, np.int32), np.array(shorter, np.int32)
        # the trie by (node, byte), hashed with linear probing; at most a fifth of it is filled
        self.arc_key = np.full(1 << max(8, (5 * len(nodes)).bit_length()), -1, np.int32)
        self.arc_to = np.zeros(len(self.arc_key), np.int32)
        key = np.array([k << 8 | c for k, arcs in enumerate(nodes) for c in arcs], np.int64)
        to = np.array([n for arcs in nodes for n in arcs.values()], np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.arc_key[slot] < 0
            self.arc_key[slot[free]] = key[free]
            won = self.arc_key[slot] == key
            self.arc_to[slot[won]] = to[won]
            key, to, slot = key[~won], to[~won], (slot[~won] + 1) & (len(self.arc_key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B1) >> 12) & (len(self.arc_key) - 1)

    def goto(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where each arc leads; 0: no such arc."""
        key = node << 8 | byte
        slot = self._slot(key)
        there = self.arc_key[slot]
        out = np.where(there == key, self.arc_to[slot], 0)
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.arc_key) - 1)
            there = self.arc_key[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.arc_to[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out

    def _same_length(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one length: a matrix filled from the right with -1 before, and the counts."""
        n, size = rows.shape
        spans = np.diff(self.label_at)
        last = np.full((size + 1, n), -1, np.int32)
        node = np.zeros(n, np.int64)
        for e in range(size):
            byte = rows[:, e]
            to = self.goto(node, byte)
            todo = np.flatnonzero((to == 0) & (node > 0))
            while len(todo):
                node[todo] = self.fail[node[todo]]
                to[todo] = self.goto(node[todo], byte[todo])
                todo = todo[(to[todo] == 0) & (node[todo] > 0)]
            node = to.astype(np.int64)
            at = np.where(self.token[node] >= 0, node, self.shorter[node])
            who = np.arange(n)
            while len(who):
                token = self.token[at[who]]
                begin = e + 1 - spans[token]
                fits = begin == 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self.arcs.has(last[begin[inner], who[inner]], token[inner])
                last[e + 1, who[fits]] = token[fits]
                who = who[~fits]
                at[who] = self.shorter[at[who]]
        out = np.full((n, size), -1, np.int32)
        count = np.zeros(n, np.int64)
        end = np.full(n, size)
        who = np.arange(n)
        while len(who):
            token = last[end[who], who]
            count[who] += 1
            out[who, size - count[who]] = token
            end[who] -= spans[token]
            who = who[end[who] > 0]
        return out, count

    def _alone(self, piece: bytes) -> list[int]:
        """Ids of one piece, by the same steps; transitions that were looked up are remembered, up to a bound."""
        if self.plain is None:
            full = self.arc_key >= 0
            arcs = dict(zip(self.arc_key[full].tolist(), self.arc_to[full].tolist(), strict=True))
            self.plain = arcs, self.fail.tolist(), self.shorter.tolist(), self.token.tolist(), np.diff(self.label_at).tolist(), {}
        arcs, fail, shorter, tokens, spans, known = self.plain
        if len(known) > 1 << 19:
            known.clear()
        size = self.size
        last = array("i", [-1]) * (len(piece) + 1)
        node = 0
        for e, byte in enumerate(piece, 1):
            to = arcs.get(node << 8 | byte)
            while to is None and node:
                node = fail[node]
                to = arcs.get(node << 8 | byte)
            node = at = to or 0
            if tokens[at] < 0:
                at = shorter[at]
            while True:
                token = tokens[at]
                begin = e - spans[token]
                if not begin:
                    break
                key = last[begin] * size + token
                fits = known.get(key)
                if fits is None:
                    fits = known[key] = bool(self.arcs.has(np.array([last[begin]]), np.array([token]))[0])
                if fits:
                    break
                at = shorter[at]
            last[e] = token
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= spans[last[end]]
        return out[::-1]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and how many each has."""
        raw = [p.encode() for p in pieces]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        counts = np.zeros(len(raw), np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(lens) - lens
        done: list[tuple[np.ndarray, np.ndarray]] = []
        special = np.array([k for k, p in enumerate(pieces) if p in self.added], np.int64)
        if len(special):
            counts[special] = 1
            done.append((special, np.array([self.added[pieces[k]] for k in special], np.int32)))
            lens = lens.copy()
            lens[special] = 0
        for size in np.unique(lens[lens > 0]).tolist():
            who = np.flatnonzero(lens == size)
            if len(who) < TOGETHER:
                for w in who.tolist():
                    ids = np.array(self._alone(raw[w]), np.int32)
                    counts[w] = len(ids)
                    done.append((np.array([w]), ids))
                continue
            step = max(1, 1_000_000 // max(size, 20))
            for a in range(0, len(who), step):
                w = who[a : a + step]
                ids, counts[w] = self._same_length(flat[first[w][:, None] + np.arange(size)[None, :]])
                done.append((w, ids[ids >= 0]))
        place = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for w, ids in done:
            n = counts[w]
            out[np.arange(len(ids)) - np.repeat(np.cumsum(n) - n - place[w], n)] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the labels of all ids, and how many each id has."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("id outside the vocabulary")
        n = (self.label_at[1:] - self.label_at[:-1])[ids]
        return self.labels[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.label_at[ids], n)], n


def automaton(path: str) -> tuple[Automaton, PieceEncoder]:
    """The compiled automaton of a vocabulary file and an encoder over it; one in each Python process."""

    def compiled() -> tuple[Automaton, PieceEncoder]:
        whole = Automaton(Vocabulary(path))
        return whole, PieceEncoder(whole.added, whole.encode)

    return kept(("automaton", path), compiled)


def _round_trip(path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, encoder = automaton(path)
        for chunk in text_chunks(batches, 1 << 20):
            ids, counts = encoder([t or "" for t in chunk.column("text").to_pylist()])
            data, per_id = compiled.decode(ids)
            ends = np.cumsum(counts)
            until = np.r_[0, np.cumsum(per_id)][np.r_[0, ends]]
            whole, raw = data.tobytes(), ids.astype("<u4").tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(until, until[1:], strict=False)]
            yield pa.record_batch({
                "doc_id": chunk.column("doc_id").combine_chunks(),
                "ids": pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary()),
                "decoded": pa.array(texts, pa.string()),
            })

    return run


def encoded_and_decoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids: the token ids as little-endian unsigned 32-bit integers, decoded: the text they stand for).

    Strings of added tokens in a text become their ids, as in the tokenizers library. A
    null or empty text has no ids. Rows, repeated ones too, are independent of each other;
    no shuffle. Text is handled in pieces of a few MB, unseen pieces go through the
    automaton, seen ones come from a cache of fixed size.
    """
    rows = ids_and_texts(docs, id_col, text_col)
    return rows.mapInArrow(_round_trip(path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encoded_and_decoded(docs, public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op4_bpe_round_trip": op4_bpe_round_trip}
ORACLES: dict[str, str] = {}
