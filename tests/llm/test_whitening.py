import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.llm import whitening as wh


def steps(vector):
    return [math.floor(1024 * float(c)) + 100_000 for c in vector]


def brute(rows, most=8):
    """{row number: (deviation, projections, shares)} and n of usable rows, with whole numbers until the eigenvectors."""
    good = [(k, steps(v)) for k, v in enumerate(rows) if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(good), len(good[0][1])
    sums = [sum(x[j] for _, x in good) for j in range(d)]
    apart = [[n * c - s for c, s in zip(x, sums, strict=True)] for _, x in good]
    scatter = np.array([[float(sum(a[i] * a[j] for a in apart)) for j in range(d)] for i in range(d)]) / float(n) ** 3
    e, q = np.linalg.eigh(scatter)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    white = np.array(apart, float) / n @ q / np.sqrt(e)
    return {k: (sum(a * a for a in x), w) for (k, _), x, w in zip(good, apart, white, strict=True)}, n, e / np.trace(scatter)


def compared(rows, got, ids):
    want, n, shares = brute(rows)
    count = len(shares)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == {ids[k] for k in want} and all(sorted(x) == list(range(1, count + 1)) for x in by_id.values())
    sign = [0.0] * count
    for k, (deviation, white) in want.items():
        for j in range(count):
            r = by_id[ids[k]][j + 1]
            assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / shares[j] - 1) < 1e-9
            assert abs(abs(r.whitened) - abs(white[j])) < 1e-8
            if abs(white[j]) > 1e-3:  # one sign for all rows
                sign[j] = sign[j] or np.sign(r.whitened * white[j])
                assert sign[j] == np.sign(r.whitened * white[j])
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    compared([r.embedding for r in rows], wh.op13_embedding_whitening(spark, sf).collect(), [r.vec_id for r in rows])


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [list(map(float, v)) for v in rng.normal(size=(300, 5)) * [5, 4, 3, 2, 1] + 50]
    rows += [rows[0]] * 100 + [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [1.0, 2.0, float("inf"), 0.0, 0.0], [1.0, 2.0, -float("inf"), 0.0, 0.0]]
    table = [(k, v, "x", 7, 1.0) for k, v in enumerate(rows)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, index string, whitened int, deviation double").repartition(5)
    got = wh.by_component(wh.whitened(df)).collect()
    assert len(got) == 400 * 5
    compared(rows, got, list(range(len(rows))))
    # vectors of another length are left out, null and repeated ids stay
    more = df.select(F.lit(None).cast("long").alias("vec_id"), "embedding").unionByName(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    assert wh.by_component(wh.whitened(more)).groupBy("vec_id").count().collect() == [(None, 2000)]


def test_little_or_no_variance_and_empty(spark):
    schema = "id string, v array<float>"
    run = lambda rows: wh.by_component(wh.whitened(spark.createDataFrame(rows, schema), "id", "v")).collect()
    assert run([]) == [] and run([("a", None), ("b", [])]) == []
    assert run([("a", [1.0, 2.0])]) == [] and run([("a", [1.0, 2.0])] * 50) == []
    line = run([(str(k), [float(k), 2.0 * k, 5.0]) for k in range(40)])  # one direction alone
    assert [r.component for r in line] == [1] * 40 and all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in line)
    square = run([(str(k), [a, b]) for k, (a, b) in enumerate([(1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)])])  # equal eigenvalues
    assert len(square) == 8 and all(abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-9 for r in square)


def test_deviations_beyond_a_long(spark):
    rows = [[1e9, 0.0], [-1e9, 1.0], [0.5, 2.0], [3e38, -3e38], [-3e38, 3e38]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    fit = wh.whitened(df)
    held = [[max(min(math.floor(max(min(1024 * c, 2.0**52), -(2.0**52))), 2**52), -(2**52)) + 100_000 for c in v] for v in rows]
    sums = [sum(x) for x in zip(*held, strict=True)]
    assert fit.sums == sums
    want = {k: sum((5 * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for k, x in enumerate(held)}
    assert {r.vec_id: int(r.deviation) for r in fit.rows.collect()} == want
    assert {r.deviation for r in wh.by_component(fit).collect() if want[r.vec_id] >= 2**63} == {None}


def test_numbers_without_gaps(spark):
    df = spark.range(1000).where("id % 7 <> 0").repartition(6).select(F.col("id").alias("vec_id"))
    numbered = wh.indexed(df)
    assert sorted(r["index"] for r in numbered.collect()) == list(range(df.count()))
    assert wh.indexed(df.limit(0)).count() == 0


def test_too_many_dimensions(spark):
    df = spark.range(1).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(1.0), 3000).alias("embedding"))
    with pytest.raises(ValueError):
        wh.whitened(df)
