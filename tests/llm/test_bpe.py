import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardloom.llm import bpe, presplit, tokens_output

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a", "  a  b\n\nc \n", "don't I'll we've'd x's ''s 's !'s\n's", "<|endoftext|> hi <|endoftext|><|endoftext|>", "日本語 ٣٤٥ ½²", "a b　c", "👨‍👩‍👧 é́", "\t\t x", "'", "' s", "ab" * 5000, "7" * 3000, " " * 99, "\n" * 20 + "x"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(3)
    return ODD + ["".join(rnd.choice("ab's tdlrve'' \n\t12.,!é<| ") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]


@pytest.mark.parametrize("make", [lambda: bpe.automaton(PATH)[1], lambda: tokens_output.library_encoder(PATH)])
def test_ids_as_the_library(tokenizer, make):
    encoder = make()
    for limit in (encoder.pool_limit, 2000):  # a small pool starts over all the time
        encoder.pool_limit = limit
        encoder.reset()
        for a in range(0, len(texts()), 97):
            part = [t or "" for t in texts()[a : a + 97]]
            ids, n = encoder(part)
            got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
            assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def literal_gadgets(size, merges):
    """The states' arcs as sets, one gadget after the other, every state touched."""
    bytes_ = set(range(size)) - {w for _, _, w in merges}
    arcs = {q: set(bytes_) for q in bytes_}
    for u, v, w in merges:
        if u not in arcs or v not in arcs[u]:
            continue
        arcs[w] = set(arcs[v])
        arcs[u].discard(v)
        for state in arcs.values():
            if u in state:
                state.add(w)
    return arcs


def same_arcs(size, merges):
    want, got = literal_gadgets(size, merges), bpe.Arcs(size, merges)
    assert {q for q in range(size) if got.read[q]} == set(want)
    read = np.array(sorted(want))
    for q in want:
        assert set(read[got.has(np.full(len(read), q), read)].tolist()) == want[q]


def test_compiled_arcs_are_those_of_the_gadgets():
    rnd = random.Random(8)
    for _ in range(40):  # merges of any parts, among them such as never meet
        size = rnd.randint(1, 6)
        merges = []
        for u, v in {(rnd.randrange(size + k), rnd.randrange(size + k)): 0 for k in range(rnd.randint(0, 90))}:
            if max(u, v) < size:
                merges.append((u, v, size))
                size += 1
        same_arcs(size, merges)
    vocabulary = presplit.Vocabulary(PATH)
    first = vocabulary.merges[:700]
    used = sorted({t for m in first for t in m})
    number = {t: k for k, t in enumerate(used)}
    same_arcs(len(used), [tuple(number[t] for t in m) for m in first])


def test_colliding_pieces_are_told_apart(tokenizer, monkeypatch):
    """With one hash for all pieces, ids still come from the pieces themselves."""
    monkeypatch.setattr(presplit, "mixed", lambda h: h * presplit.U64(0) + presplit.U64(5))
    encoder = presplit.PieceEncoder(bpe.automaton(PATH)[0].added, bpe.automaton(PATH)[0].encode)
    for part in (["one two three", "two", ""], ["two", "three one"]):
        ids, n = encoder(part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_classes_as_the_library(tokenizer):
    """A letter joins a letter, a digit a digit, white space nothing."""
    table = presplit.classes()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in (0x27,)]
    for lead, kind in (("a", presplit.LETTER), ("1", presplit.DIGIT), ("!", presplit.OTHER)):
        whole = "".join(f"\n{lead}{chr(c)}" for c in points[::7])
        starts = {a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(whole)}
        joined = [3 * k + 2 not in starts for k in range(len(points[::7]))]
        assert joined == [bool(table[c] == kind) for c in points[::7]]


def test_round_trip_query(spark, sf, tokenizer):
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts())], "doc_id long, text string, ids int")
    rows = {r.doc_id: r for r in bpe.encoded_and_decoded(docs, PATH).collect()}
    for k, t in enumerate(texts()):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[k].ids, "<u4").tolist() == want
        assert rows[k].decoded == (t or "") == tokenizer.decode(want, skip_special_tokens=False)
    assert bpe.digests(bpe.encoded_and_decoded(docs.limit(0), PATH)).count() == 0


def test_token_files(spark, tmp_path, tokenizer):
    docs = spark.createDataFrame([(None if k == 7 else k * 3 // 2, t, "x") for k, t in enumerate(texts())], "doc_id long, text string, part string")
    out = str(tmp_path / "tokens")
    tokens_output.write_tokens(docs, out, PATH, end=2)
    got = sorted(tuple(r) for r in tokens_output.read_checked(spark, out).collect() if r.doc_id is not None)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        if r.doc_id is not None:
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    meta = tokens_output.read_metadata(spark, out).where("doc_id is not null").select("doc_id", "start", "n_tokens")
    assert sorted(tuple(r) for r in meta.collect()) == sorted(w[:3] for w in want)


def test_layout_of_token_files(spark, tmp_path):
    """Dictionary-encoded ids, delta-encoded metadata, row groups and pages of set sizes, indexes; metadata are read without the ids."""
    import glob

    import pyarrow.parquet as pq

    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 99)) for _ in range(300))) for k in range(3000)]
    out = str(tmp_path / "t")
    tokens_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), out, PATH, row_group_bytes=256 << 10, page_bytes=16 << 10)
    groups = 0
    for name in glob.glob(f"{out}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            assert ids.has_dictionary_page and ids.has_offset_index and ids.has_column_index and ids.compression == "ZSTD"
            for n in ("row", "doc_id", "n_tokens", "part"):
                assert not columns[n].has_dictionary_page and any(e.startswith("DELTA") for e in columns[n].encodings), columns[n].encodings
                assert columns[n].has_offset_index
    assert groups > 1
    plan = tokens_output.read_metadata(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "ids" not in plan.split("ReadSchema", 1)[1].split("\n")[0]
    starts = {r.doc_id: (r.start, r.n_tokens) for r in tokens_output.read_metadata(spark, out).collect()}
    # a few rows' ids alone: the filter reaches the scan
    some = spark.read.parquet(out).where("doc_id BETWEEN 1500 AND 1503").select("doc_id", "ids")
    assert "PushedFilters: [IsNotNull(doc_id)" in some._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: len(r.ids) for r in some.collect()} == {d: starts[d][1] for d in range(1500, 1504)}
    assert all(starts[d + 1][0] == starts[d][0] + starts[d][1] for d in range(2999))


@pytest.fixture(scope="module")
def encoder():
    return bpe.automaton(PATH)[1]


def test_one_long_piece_is_read_in_one_pass(tokenizer, encoder):
    """Pieces of one kind of character, as rules of dashes and lines of base64 are: a step a byte, whatever their tokens' length."""
    rng = random.Random(8)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(20_000))
    for text in ("-" * 20_000, "a" * 100_000, "=" * 777, "の" * 5_000, letters, "-=" * 3_000, "1" * 4_000, " " * 3_000, "x" + " \n" * 500):
        begin = time.perf_counter()
        ids, counts = encoder([text])
        took = time.perf_counter() - begin
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
        assert took < 10, (text[:5], took)


def test_alone_and_together_agree():
    compiled = bpe.automaton(PATH)[0]
    rng = random.Random(9)
    pieces = ["".join(rng.choice(" aetho-1é汉") for _ in range(12)).encode()[:12] for _ in range(200)]
    for size in {len(p) for p in pieces}:
        own = [p for p in pieces if len(p) == size]
        ids, counts = compiled._same_length(np.array([list(p) for p in own], np.uint8))
        assert [row[row >= 0].tolist() for row in ids] == [compiled._alone(p) for p in own]


def test_queries_over_documents_against_the_library(spark, sf, tokenizer):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in docs}
    raw = lambda x: b"".join(i.to_bytes(4, "little") for i in x)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op4_bpe_round_trip(spark, sf).collect()}
    assert got == {d: (len(x), hashlib.sha256(raw(x)).hexdigest(), hashlib.sha256(tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest()) for d, x in ids.items()}
    start, want = 0, {}
    for d, _ in docs:
        own = [*ids[d], 2]
        want[d] = (start, len(own), zlib.crc32(raw(own)))
        start += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens_output.op3_token_id_output(spark, sf).collect()} == want
