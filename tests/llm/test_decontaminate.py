import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from cardloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, window=13):
    found = {}
    for item, text in bench:
        w = words(text)
        if item is None or not w:
            continue
        size = min(window, len(w))
        for k in range(len(w) - size + 1):
            found.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    sizes = {len(p) for p in found}
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, items = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                own = found.get(tuple(w[k : k + size]))
                if own:
                    items |= own
                    hit |= set(range(k, k + size))
        out[doc] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def read(df):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}


def digest(df):
    F = dc.F
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), dc.contaminated().alias("contaminated"))


def test_against_brute_force(spark, sf):
    table = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*(("doc_id", "text") if t == "documents" else ("item_id", "text"))).collect()]
    want = brute(table("documents"), table("benchmark"))
    assert any(w[4] for w in want.values())
    assert read(dc.op10_benchmark_decontamination(spark, sf)) == want


def test_short_items_ties_nulls_and_passes(spark):
    rnd = random.Random(2)
    vocab = [f"w{k}" for k in range(12)] + ["ÜBER", "é", "7"]
    bench = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 20)))) for k in range(30)] + [(3, "w1 w2"), (None, "w1"), (40, None), (41, "")]
    docs = [(k, " ".join(rnd.choice([*vocab, "zz", "\n", "A-b"]) for _ in range(rnd.randint(0, 80)))) for k in range(120)]
    docs += [(1000, None), (1001, ""), (1002, "w1 w2 " * 20_000), (1003, (bench[5][1] + " . ") * 500)]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    assert read(digest(dc.contamination(d, b))) == want
    assert read(digest(dc.contamination(d, b, block_bytes=200, blocks_a_pass=3))) == want
    assert dc.contamination(d.limit(0), b).count() == 0
    none = read(digest(dc.contamination(d, b.limit(0))))
    assert {k: v[0] for k, v in none.items()} == {k: v[0] for k, v in want.items()} and not any(v[1] for v in none.values())


def test_documents_and_benchmark_without_a_common_word(spark):
    docs = [(1, "alpha beta gamma"), (2, "слова без эталона"), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    for bench in ([(1, "one two three")], [(1, "one"), (2, "two " * 20)]):
        b = spark.createDataFrame(bench, "item_id long, text string")
        assert read(digest(dc.contamination(d, b))) == brute(docs, bench)
        assert read(digest(dc.contamination(d, b, block_bytes=2, blocks_a_pass=1))) == brute(docs, bench)


def test_spans_are_byte_ranges(spark):
    d = spark.createDataFrame([(1, "é One two, THREE four. one two three")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    row = dc.contamination(d, b).first()
    text = row.text.encode()
    assert [text[s.begin : s.end].decode() for s in row.spans] == ["One two, THREE", "one two three"]


def test_index():
    rnd = np.random.RandomState(1)
    text = np.r_[0, rnd.randint(1, 4, 300), 0, rnd.randint(0, 4, 200), 0]
    index = dc.FMIndex(text, 4)
    for size in (1, 2, 3, 5):
        p = rnd.randint(1, 4, (40, size))
        lo, hi = index.search(p.ravel(), np.arange(40) * size, size)
        for k in range(40):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p[k]).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    """With four hashes for all words the same windows are found."""
    texts = ["alpha beta gamma delta", "beta beta", None, "other words alpha beta gamma here"]
    data, offsets = dc.raw_bytes(pa.array(texts))
    is_word = dc.IS_WORD[data]
    words = data, is_word, *dc.word_bounds(is_word, offsets)

    def hits():
        phrases = dc.Phrases(["x", "y", "z"], pa.array(["beta gamma", "", "alpha beta gamma delta"]), 3)
        first, last, items = phrases.hits(*words)
        return sorted(zip(first.tolist(), last.tolist(), strict=True)), items

    want = hits()
    assert want[1] == {0: {"x", "z"}, 3: {"x", "z"}}
    real = dc.span_hashes
    monkeypatch.setattr(dc, "span_hashes", lambda *a: real(*a) & np.uint64(3))
    assert hits() == want


def test_memory_of_a_block():
    """A block's phrases take some tens of bytes a word, windows included."""
    rnd = np.random.RandomState(2)
    texts = [" ".join(f"w{k}" for k in rnd.randint(0, 5000, 400)) for _ in range(300)]
    phrases = dc.Phrases([str(k) for k in range(300)], pa.array(texts), 13)
    arrays = [phrases.hashes, phrases.size, phrases.at, phrases.words, phrases.symbols, *(x for pair in phrases.by_size.values() for x in pair)]
    assert sum(a.nbytes for a in arrays) < 30 * 120_000
