import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cardloom.llm import lm


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


class Brute:
    def __init__(self, texts):
        self.n = defaultdict(Counter)
        for t in texts:
            line = [lm.PAD] * lm.ORDER + [*b" ".join(words(t)), lm.END]
            for i in range(lm.ORDER, len(line)):
                for k in range(lm.ORDER + 1):
                    self.n[tuple(line[i - k : i])][line[i]] += 1

    def p(self, ctx, s):
        p, gone = 1.0, set()
        for k in range(lm.ORDER, -1, -1):
            own = self.n.get(tuple(ctx[len(ctx) - k :]))
            if own is None:
                continue
            left = {x: c for x, c in own.items() if x not in gone}
            room = 2 * sum(left.values())
            if s in left:
                return p * (2 * left[s] - 1) / room
            if left:
                p *= len(left) / room
            gone = set(own)
        return p / (lm.SYMBOLS - len(gone))

    def score(self, t):
        line = [lm.PAD] * lm.ORDER + [*b" ".join(words(t)), lm.END]
        return sum(math.log10(self.p(line[i - lm.ORDER : i], line[i])) for i in range(lm.ORDER, len(line)))


def brute(docs, train):
    model = Brute([t for d, t in docs if train(d)])
    c = Counter(w for d, t in docs if train(d) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in docs:
        ws = [*words(t), None]
        out[d] = (not train(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), model.score(t))
    return out


def same(rows, want):
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:4] == w[:4], (d, got[d], w)
        assert np.allclose(got[d][4:], w[4:], rtol=1e-5, atol=1e-4), (d, got[d], w)


def test_query_against_brute_force(spark, sf):
    """Every document of the smallest table."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(lm.op1_ppm_scores(spark, sf).collect(), brute(docs, lambda d: zlib.crc32(str(d).encode()) % 10 != 0))


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    held = lm.op1_ppm_scores(spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)


def test_odd_rows(spark, monkeypatch):
    rnd = random.Random(3)
    docs = [(k, "".join(rnd.choice("abC é\t ") for _ in range(rnd.randint(0, 60)))) for k in range(80)] + [(100, None), (101, ""), (102, " \n"), (103, "Ab " * 5000), (104, "zzzÿ")]
    df = spark.createDataFrame([(a, b, True, 1) for a, b in docs], "doc_id long, text string, train boolean, block int")
    same(lm.scored(df, F.col("doc_id") % 3 != 0, block_bytes=2000).collect(), brute(docs, lambda d: d % 3 != 0))
    same(lm.scored(df, F.lit(False)).collect(), brute(docs, lambda d: False))
    for hot_count in (0, 5, 200):  # all contexts of three bytes, some, few are dealt by four
        same(lm.scored(df, F.col("doc_id") % 3 != 0, block_bytes=2000, hot_count=hot_count).collect(), brute(docs, lambda d: d % 3 != 0))
    monkeypatch.setattr(lm, "BUCKET_BYTES", 300)  # many buckets in a task
    again = df.unionByName(spark.createDataFrame([(None, "ab abra", True, 1), (None, None, True, 1), *[(5, docs[5][1], True, 1)] * 3], df.schema))  # null ids, repeated rows
    rows = lm.scored(again, F.col("doc_id") % 3 != 0, block_bytes=2000).collect()
    more = brute([*docs, *[(5, docs[5][1])] * 3, (None, "ab abra"), (None, None)], lambda d: d is not None and d % 3 != 0)
    same([r for r in rows if r.doc_id is not None and r.doc_id != 5], {d: w for d, w in more.items() if d not in (None, 5)})
    assert len(rows) == len(docs) + 5 and len({(r.score, r.base_score) for r in rows if r.doc_id == 5}) == 1
    assert sorted(r.n_tokens for r in rows if r.doc_id is None) == [1, 3] and not any(r.held_out is False for r in rows if r.doc_id is None)
    assert lm.scored(df.limit(0), F.lit(True)).count() == 0


def test_probabilities_add_up_to_one():
    model = Brute(["abra kadabra", "ABBA ab", None])
    keys, counts = [], []
    for ctx, own in model.n.items():
        if len(ctx) == lm.ORDER:
            for s, c in own.items():
                key = s
                for k in range(1, lm.ORDER + 1):
                    key |= ctx[-k] << 8 * (lm.ORDER + 1 - k)
                keys.append(key)
                counts.append(c)
    order = np.argsort(np.array(keys, np.uint64))
    levels = lm.levels_of(np.array(keys, np.uint64)[order], np.array(counts)[order], lm.ORDER, range(lm.ORDER + 1), {})
    for ctx in ([97, 98, 114, 97, 32], [lm.PAD] * 5, [1, 2, 3, 4, 5], [9, 9, 9, 98, 98]):
        base = sum(ctx[-k] << 8 * (lm.ORDER + 1 - k) for k in range(1, lm.ORDER + 1))
        p = 10 ** lm.code_lengths(np.array([base | s for s in range(256) if s != lm.PAD], np.uint64), levels)
        assert abs(p.sum() - 1) < 1e-9
        assert np.allclose(p, [model.p(ctx, s) for s in range(256) if s != lm.PAD])
