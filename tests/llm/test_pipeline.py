import hashlib

import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline as cp
from cardloom.llm import quality

from .test_decontaminate import brute as brute_hits
from .test_simhash import brute as brute_groups
from .test_suffixes import brute as brute_repeats


def kept_by_brute(docs, k=50):
    """Texts without repeated bytes and cut code points."""
    least = {}
    for d, t in docs:
        raw = t.encode()
        for i in range(len(raw) - k + 1):
            least[raw[i : i + k]] = min(least.get(raw[i : i + k], d), d)
    out = {}
    for d, t in docs:
        raw, gone = t.encode(), set()
        for i in range(len(raw) - k + 1):
            if least[raw[i : i + k]] < d:
                gone |= set(range(i, i + k))
        out[d] = bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")
    return out


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name.startswith("quality"):
            model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            scores = model.scores(pa.array(list(rows.values())))
            want = {d: t for (d, t), s in zip(rows.items(), scores, strict=True) if s >= 0.3}
            assert 0 < len(want) < len(rows)
        elif name.startswith("simhash"):
            want = {d: rows[d] for d, (_, c) in brute_groups(list(rows.items()), prints=2).items() if d == c}
            assert len(want) < len(rows)
        elif name.startswith("suffix"):
            assert brute_repeats(list(rows.items()))
            want = kept_by_brute(list(rows.items()))
            assert want != rows
        elif name.startswith("benchmark"):
            hits = brute_hits(list(rows.items()), bench)
            want = {d: t for d, t in rows.items() if not hits[d][4]}
            assert len(want) < len(rows)
        else:
            tokenizer = Tokenizer.from_file(cp.public_tokenizers.path("byte_bpe_50k.json"))
            got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in out.collect()}
            assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, out.collect()))  # the same from end to end
            assert got == {d: (len(tokenizer.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows.items()}
            continue
        assert out.columns == cp.COLUMNS
        got = {r.doc_id: r for r in out.collect()}
        assert {d: r.text for d, r in got.items()} == want
        assert all(r.n_chars == len(r.text) for r in got.values())
        docs = spark.createDataFrame([tuple(r) for r in got.values()], docs.schema)
        rows = want


def test_run_and_empty_and_null_rows(spark, sf):
    assert cp.run(spark, sf).count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(30).selectExpr("doc_id", "if(doc_id % 3 = 0, null, text) text", "null::string lang", "source", "n_chars", "1 as label", "'x' as component").unionByName(docs.limit(2).selectExpr("null::bigint doc_id", "text", "lang", "source", "n_chars", "1 label", "'x' component"))
    for start in (odd, odd.limit(0)):
        now = start
        for _, stage in cp.STAGES:
            now = stage(spark, now, sf)
        assert (now.count() > 0) == (start is odd)


def test_near_dedup_of_repeated_ids(spark):
    """Rows that repeat an id stay or go by their own texts."""
    words = lambda k, n=300: " ".join(f"w{k}x{i}" for i in range(n))
    near = words(4) + " end"
    assert [c for _, c in brute_groups([(0, words(4)), (1, near)]).values()] == [0, 0]
    rows = [(1, words(1)), (5, words(1)), (5, words(2)), (7, words(3)), (7, words(3)), (7, words(4)), (7, near), (8, near), (9, None), (9, ""), (None, words(1)), (None, words(1))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.near_dedup(spark, docs, "").collect()]
    assert sorted(t for d, t in got if d in (1, 5)) == [words(1), words(2)]
    seven = [t for d, t in got if d == 7]
    assert len(seven) == 2 and words(3) in seven and (words(4) in seven or near in seven)
    assert sum(d == 8 for d, _ in got) == 0 and sum(d == 9 for d, _ in got) == 1 and sum(d is None for d, _ in got) == 2
