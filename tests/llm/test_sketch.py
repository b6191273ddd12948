import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from cardloom.llm import sketch


def brute(rows):
    """rows: (id, text) in any order -> per row the edited text and the likenesses of sets of kept hashes."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] is not None, r[1] or ""))

    def kept(t):
        return set(sketch.sketches(pa.array([t]))[1].tolist())

    def near(a, b):
        return len(a & b) / min(len(a), len(b)) if a and b else float(a == b)

    out = []
    for k, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        a = kept(t)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{h:016x}" for h in sorted(a)), near(a, kept(e)), near(a, kept(nxt))))
    return sorted(out, key=str)


def read(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in df.collect()), key=str)


def test_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sketch.op7_scaled_sketch(spark, sf)
    assert read(got) == brute(rows)
    mean = got.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert mean[0] > 0.6 and mean[1] < 0.1


def test_odd_rows(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, "", "a", "a b", "é 😀 " * 30, " ".join(rnd.choice("abcdefgh") for _ in range(60))])) for _ in range(200)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, ghost int, part int")
    assert read(sketch.sketch_of_edits(df)) == brute(rows)
    assert read(sketch.sketch_of_edits(df.limit(1))) == brute([tuple(df.limit(1).first())[:2]])
    assert sketch.sketch_of_edits(df.limit(0)).count() == 0


def test_kept_share_and_columns(spark):
    text = " ".join(f"w{k}" for k in range(40_000))
    rows, hashes = sketch.sketches(pa.array([text, None, "one"]))
    assert abs((rows == 0).sum() / 40_000 - 1 / 8) < 0.01 and (rows == 2).sum() == 1 and (rows == 1).sum() == 0
    half = " ".join(text.split(" ")[:10_000])
    df = sketch.sketch(spark.createDataFrame([(1, text), (2, half), (3, "")], "doc_id long, text string"))
    a = df.where("doc_id=1").select(F.col("fingerprint").alias("x"))
    near = {r.doc_id: r.n for r in df.crossJoin(a).select("doc_id", sketch.estimate("fingerprint", "x").alias("n")).collect()}
    assert near == {1: 1.0, 2: 1.0, 3: 0.0}


def test_ids_of_other_types(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["b", "a1", "é", "", None, "zz", "😀"]) if k % 3 else f"id{k}", " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 40)))) for k in range(120)]
    want = brute([(None if d is None else d.encode(), t) for d, t in rows])
    got = sketch.sketch_of_edits(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(((None if d is None else d.encode(), *rest) for d, *rest in read(got)), key=str) == want
    dated = spark.createDataFrame([(k, "x y z") for k in range(9)], "k int, text string").selectExpr("date_add(DATE '2026-01-01', k) AS doc_id", "text")
    assert sketch.sketch_of_edits(dated).count() == 9


def test_merged_sketches_are_those_of_both_texts(spark):
    """The sketch of two texts' shingles together comes from their sketches alone, short texts included."""
    rnd = random.Random(7)
    short = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(n))
    pairs = [(short(rnd.choice([0, 1, 5, 6, 7, 60])), short(rnd.choice([0, 1, 5, 6, 7, 60]))) for _ in range(150)]
    ta, tb = pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])
    df = spark.createDataFrame(list(zip(sketch.texts_of(150, *sketch.sketches(ta)), sketch.texts_of(150, *sketch.sketches(tb)), strict=True)), "a string, b string")
    got = [r.m for r in df.select(sketch.merged("a", "b").alias("m")).collect()]
    for k in range(150):
        every = sorted({h for t in (ta, tb) for h in sketch.sketches(t.slice(k, 1), one_in=1)[1].tolist()})
        low = [h for h in every if h < (1 << 64) // sketch.ONE_IN] or every[:1]
        assert got[k] == "".join(f"{h:016x}" for h in low)
