import numpy as np
import pyarrow as pa

from cardloom.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op8_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = got.where("held_out").join(labels, "doc_id").toPandas()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert ((both.score >= 0) & (both.score <= 1)).all()
    pos, neg = both.score[both.quality == 1].values, both.score[both.quality == 0].values
    auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert auc > 0.95, auc
    assert (both.predicted == both.quality).mean() > 0.93


def test_features_once_and_by_row():
    rows, cols = quality.features(pa.array(["a a a", None, "", "A a", "x!! y"]))
    assert set(rows.tolist()) == {0, 3, 4}
    assert len(set(zip(rows.tolist(), cols.tolist(), strict=True))) == len(rows)
    assert (np.bincount(rows)[[0, 3]] == [4, 5]).all()  # 0: word, pair, shape, shape pair


def test_no_labels_one_class_and_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x"), (1, None), (2, ""), (3, "fine text here"), (3, "fine text here"), (4, "w " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    one = quality.train(docs, none)
    assert {r.score for r in quality.scored(docs, one).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 1, "a"), (3, None, "b"), (None, 0, "c"), (77, 0, "d")], "doc_id long, quality int, text string")
    model = quality.train(docs, labels)
    assert all(r.score > 0.9 for r in quality.scored(docs, model).collect())
    assert quality.scored(docs.limit(0), model).count() == 0


def test_descent_separates():
    texts = pa.array([f"good word{k % 7} fine" if k % 2 else f"bad word{k % 7} poor" for k in range(80)])
    model = quality.fit(texts, np.arange(80) % 2)
    s = model.scores(texts)
    assert s[1::2].min() > 0.5 > s[::2].max()


def test_descent_solves_the_hinge_dual():
    """Against projected gradient steps on the whole dual: max sum(a) - |sum(a y x)|^2 / 2 over 0 <= a <= cost."""
    rnd = np.random.RandomState(3)
    for cost in (0.05, 0.5, 5.0):
        ratio = rnd.randn(12)
        rows = [np.flatnonzero(rnd.rand(12) < 0.5) for _ in range(40)]
        y = np.where(rnd.rand(40) < 0.5, 1.0, -1.0)
        x = np.zeros((40, 13))
        x[:, 12] = 1
        for i, r in enumerate(rows):
            x[i, r] = ratio[r] / np.sqrt(max(len(r), 1))
        q = (x * y[:, None]) @ (x * y[:, None]).T
        a = np.zeros(40)
        for _ in range(60_000):
            a = np.clip(a + (1 - q @ a) / np.linalg.norm(q, 2), 0, cost)
        w, b, alpha = quality._descent(np.r_[0, np.cumsum([len(r) for r in rows])], np.concatenate(rows), ratio, y, cost, 4000, enough=1e-6)
        assert alpha.min() >= 0 and alpha.max() <= cost
        assert np.allclose(np.r_[w, b], (alpha * y) @ x, atol=1e-3)
        dual = lambda v: v.sum() - v @ q @ v / 2
        assert abs(dual(alpha) - dual(a)) < 1e-3 * max(1, abs(dual(a)))
        primal = (w @ w + b * b) / 2 + cost * np.maximum(0, 1 - y * (x @ np.r_[w, b])).sum()
        assert abs(primal - dual(alpha)) < 1e-2 * max(1, primal)


def test_ratios_scores_and_repeated_labels(spark):
    """A model's score of a text, from its features one by one; labels that conflict count as the largest."""
    texts = [f"alpha{k % 3} beta{k % 5} {'Good' if k % 2 else 'bad!'} x" for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, "zz"), (3, "alpha")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, 0), (5, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    again = quality.train(docs.repartition(3), labels.repartition(5))
    assert (model.weights == again.weights).all() and model.bias == again.bias
    got = {(r.doc_id, r.score) for r in quality.scored(docs, model).collect()}
    for k in (0, 7, 59):
        _, cols = quality.features(pa.array([texts[k]]))
        margin = sum(float(model.weights[c]) for c in cols) / np.sqrt(len(cols)) + model.bias
        want = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -50, 50)))
        assert any(i == k and abs(s - want) < 1e-9 for i, s in got)
    assert min(s for i, s in got if i in (7, 59)) > max(s for i, s in got if i in (0, 58))


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * 100) for k in range(40)] + [(40, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(41)], "doc_id long, quality int")
    texts = lambda **bound: [r.text for r in quality.sampled(docs, labels, **bound).collect()]
    whole, few, small = texts(), texts(sample_rows=10), texts(sample_bytes=2000)
    assert len(whole) > 25 and few == whole[:10] and 0 < len(small) < 8 and small == whole[: len(small)]
    assert sum(len(t or "") for t in small) <= 2000 < sum(len(t or "") for t in whole[: len(small) + 1])
