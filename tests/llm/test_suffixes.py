import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from cardloom.llm import suffixes as sx


def brute(docs, k=50):
    least = {}
    for d, t in docs:
        raw = (t or "").encode()
        key = sx.NO_ID if d is None else d
        for i in range(len(raw) - k + 1):
            s = raw[i : i + k]
            least[s] = min(least.get(s, sx.NO_ID), key)
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        key = sx.NO_ID if d is None else d
        gone = bytearray(len(raw))
        for i in range(len(raw) - k + 1):
            if least[raw[i : i + k]] < key:
                gone[i : i + k] = b"\1" * k
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def read(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted((tuple(r) for r in sx.op9_suffix_array_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    want = brute(docs)
    assert rows == want
    assert sum(w[2] for w in want) > 0


def test_odd_rows(spark):
    rnd = random.Random(5)
    passages = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(30, 160))) for _ in range(8)]
    docs = [(rnd.choice([None, *range(40)]), "".join(rnd.choice([*passages, "x" * rnd.randint(0, 120), "ab" * rnd.randint(0, 60)]) for _ in range(rnd.randint(0, 6)))) for _ in range(70)]
    docs += [(200, None), (201, ""), (202, "a" * 49), (203, "a" * 49), (204, "z" * 50), (205, "z" * 50), (206, passages[0] * 300), (207, "ab" * 40_000)]
    df = spark.createDataFrame([(a, b, 1, b"") for a, b in docs], "doc_id long, text string, block int, kept binary")
    want = brute(docs)
    assert read(sx.repeats_removed(df, block_bytes=3000, sorted_together=500)) == want
    assert read(sx.repeats_removed(df)) == want
    assert sx.repeats_removed(df.limit(0)).count() == 0


def test_cover_and_suffix_order():
    assert (sx._shift >= 0).all()
    rnd = np.random.RandomState(2)
    text = np.concatenate([rnd.randint(1, 3, 60), np.tile([1, 2, 1], 60), rnd.randint(1, 3, 200), np.tile([1, 2, 1], 60)])
    symbols = np.r_[text, np.zeros(128, int)].astype(np.uint16)
    starts = np.arange(len(text) - 50)
    order, _ = sx.sorted_suffixes(symbols, starts)
    depth = [tuple(symbols[s : s + 56]) for s in starts[order]]
    assert depth == sorted(depth)
    ids = rnd.randint(0, 9, len(starts))
    got = sx.earlier(symbols, starts, ids)
    for i in starts:
        assert got[i] == any(ids[j] < ids[i] and (symbols[i : i + 50] == symbols[j : j + 50]).all() for j in starts)


def test_fragments_cover_every_place_across_segments(monkeypatch):
    monkeypatch.setattr(sx, "SEGMENT", 97)
    rnd = np.random.RandomState(3)
    lens = [0, 49, 50, 51, 400, 0, 130]
    data = rnd.randint(97, 99, sum(lens)).astype(np.uint8)
    offsets = np.r_[0, np.cumsum(lens)]
    f = sx.Fragments(data, offsets, np.arange(len(lens)))
    got = sorted(p for a, c in zip(f.at, f.count, strict=True) for p in range(a, a + c))
    assert got == [p for a, b in zip(offsets, offsets[1:], strict=False) for p in range(a, b - 49)]
    assert f.count.max() <= sx.WINDOW


def test_equal_hashes_of_unequal_fragments(spark, monkeypatch):
    """Bytes decide, not hashes: with one hash for all of them every fragment is compared."""
    from cardloom.llm import common

    rnd = np.random.RandomState(4)
    data = rnd.randint(97, 99, 900).astype(np.uint8)
    data[300:420] = data[:120]
    at, size = np.arange(0, 800, 10), rnd.choice([50, 60], 80)
    pick, of = common.exact_groups(np.zeros(80, np.uint64), data, at, size)
    for k in range(80):
        p = pick[of[k]]
        assert size[k] == size[p] and (data[at[k] : at[k] + size[k]] == data[at[p] : at[p] + size[p]]).all()
    assert of[30] == of[0] or size[30] != size[0]
    with pytest.raises(TypeError):
        sx.repeats_removed(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_a_hot_seed_is_dealt_string_by_string(spark, monkeypatch):
    """Long runs of blanks between differing words: one seed with very many strings; several buckets in a task."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 12)))
    docs = [(k, (" " * 30).join(word() for _ in range(rnd.randint(2, 30)))) for k in range(60)] + [(k, docs_text) for k, docs_text in ((70, "x" + " " * 90 + "y"), (71, "z" + " " * 70), (72, None))]
    docs += [(80 + k, docs[k][1][: 40 * k] + word()) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert sum(w[2] for w in want) > 1000
    monkeypatch.setattr(sx, "BUCKET_BYTES", 700)
    for together in (50, 400, 100_000):
        assert read(sx.repeats_removed(df, block_bytes=4000, sorted_together=together)) == want
    # the seed is found to be hot, and only with the smaller bounds
    table = pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs], "block": pa.array([0] * len(docs), pa.int64())})
    asked = sx._ask_seeds(1)(table)
    for together, some in ((400, True), (100_000, False)):
        answer = next(iter(sx._answer_seeds(together)(iter(asked.to_batches()))))
        bits = np.unpackbits(np.frombuffer(answer.column("payload")[0].as_py(), np.uint8)).reshape(-1, 2)
        assert bool(bits[:, 1].any()) == some and bits[:, 0].any()
