"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: words, word pairs, word shapes and shape pairs
(a shape keeps punctuation and turns runs of capitals, small letters and digits into one
sign each). Each indicator is scaled by its class log-count ratio; a linear hinge-loss model
is fitted on top by dual coordinate descent, and its margins become probabilities by a
logistic curve fitted on rows it hasn't seen.

The model is fitted on a bounded sample of labelled rows (``sample_rows``); it is an array
of 2 ** BITS weights whatever the input, so that it can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, U64, ids_and_texts, mixed, raw_bytes, small_batches, span_hashes, text_chunks, tidy, word_bounds

BITS = 18
SLICE = 250  # sample texts whose features are made at once
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91] = 65
SHAPE[97:123] = SHAPE[128:] = 97
SHAPE[48:58] = 48


def features(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of every indicator that is on, sorted, each once."""
    data, offsets = raw_bytes(texts)
    is_word = ~IS_SPACE[data]
    starts, stops, row = word_bounds(is_word, offsets)
    word = span_hashes(LOWER[data], is_word, starts, stops)
    shape = SHAPE[data]
    first = is_word.copy()
    first[1:] &= (shape[1:] != shape[:-1]) | ~is_word[:-1]
    first[starts] = True
    at = np.cumsum(first)
    shapes = span_hashes(shape, first, at[starts] - 1, at[stops - 1]) if len(starts) else word
    keys = []
    for salt, h in ((1, word), (2, shapes)):
        one = mixed(h + U64(salt)) >> U64(64 - BITS)
        keys.append((row.astype(U64) << U64(BITS)) | one)
        same = row[1:] == row[:-1]
        two = mixed(h[:-1] * U64(3) + h[1:] + U64(salt + 4)) >> U64(64 - BITS)
        keys.append(((row[1:].astype(U64) << U64(BITS)) | two)[same])
    key = np.sort(np.concatenate(keys))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> U64(BITS)).astype(np.int64), (key & U64((1 << BITS) - 1)).astype(np.int64)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def margins(self, n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        size = np.bincount(rows, minlength=n)
        return np.bincount(rows, weights=self.weights[cols], minlength=n) / np.sqrt(np.maximum(size, 1)) + self.bias

    def scores(self, texts: pa.ChunkedArray | pa.Array) -> np.ndarray:
        z = self.slope * self.margins(len(texts), *features(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _descent(cuts: np.ndarray, cols: np.ndarray, ratio: np.ndarray, y: np.ndarray, cost: float, rounds: int, seed: int = 5, enough: float = 0.05) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent for the linear hinge loss: 0 <= alpha <= cost; the bias is one more feature that
    is always on. Ends after ``rounds``, or when no row's projected gradient exceeds ``enough``. Weights, bias, alpha."""
    w, b = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(y))
    rows = [cols[a:e] for a, e in zip(cuts, cuts[1:], strict=False)]
    values = [(ratio[c] / np.sqrt(max(len(c), 1))).astype(np.float32) for c in rows]
    norm = np.array([float(v @ v) for v in values]) + 1
    rnd = np.random.RandomState(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rnd.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            if new != alpha[i]:
                worst = max(worst, abs(g))
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[rows[i]] += step * values[i]
                b += step
        if worst <= enough:
            break
    return w, b, alpha


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margins to the chance of class 1 (Newton steps)."""
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        grad = x.T @ (p - t) + 1e-3 * theta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(texts: pa.ChunkedArray | pa.Array, labels: np.ndarray, cost: float = 1.0, rounds: int = 12) -> Model:
    """A model of P(label = 1). Without rows of both classes every score is the rows' mean (0.5 of none)."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        p = 0.5 if not len(y) else 0.99 if y[0] > 0 else 0.01
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(p / (1 - p))))
    parts = [features(texts.slice(a, SLICE)) for a in range(0, len(y), SLICE)]
    rows = np.concatenate([r.astype(np.int32) + a for (r, _), a in zip(parts, range(0, len(y), SLICE), strict=True)])
    cols = np.concatenate([c.astype(np.int32) for _, c in parts])
    del parts
    cuts = np.searchsorted(rows, np.arange(len(y) + 1))
    learn = np.ones(len(y), bool)
    learn[::5] = False  # for the curve
    if len(set(y[learn].tolist())) < 2:
        learn[:] = True
    on = learn[rows]
    pos = np.bincount(cols[on & (y[rows] > 0)], minlength=1 << BITS) + 1.0
    neg = np.bincount(cols[on & (y[rows] < 0)], minlength=1 << BITS) + 1.0
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    own = np.flatnonzero(learn)
    picked = np.concatenate([cols[cuts[i] : cuts[i + 1]] for i in own])
    w, b, _ = _descent(np.r_[0, np.cumsum(np.diff(cuts)[own])], picked, ratio, y[own], cost, rounds)
    model = Model(w * ratio, b, 1.0, 0.0)
    margin = model.margins(len(y), rows, cols)
    rest = ~learn if (~learn).any() and len(set(y[~learn].tolist())) == 2 else learn
    model.slope, model.shift = _curve(margin[rest], y[rest])
    return model


def held_out(id_col: str = "doc_id", of: int = 5):
    """Rows never learned from: crc32 of the id as text, modulo ``of``, is 0 (null ids too)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == 0, F.lit(True))


def sampled(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8_000, sample_bytes: int = 48 << 20) -> DataFrame:
    """(label, text) of at most ``sample_rows`` labelled rows outside the held-out fifth, chosen by a hash of their id, of
    which those in that order whose texts sum to at most ``sample_bytes``; one partition, in that order.

    Labels and ids that are null are ignored; of several labels or rows of one id the largest
    label and the first text in order count.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out("_id"))
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    rows = ids_and_texts(docs, id_col, text_col)
    place = [F.xxhash64(F.col("_id").cast("string")), F.col("_id")]
    chosen = known.orderBy(*place).limit(sample_rows)
    # sizes first: sample_rows small rows in one window
    sizes = rows.join(F.broadcast(chosen), rows.doc_id == F.col("_id")).groupBy("_id", "_label").agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0)).cast("long").alias("_size"))
    fit_in = sizes.withColumn("_upto", F.sum("_size").over(Window.orderBy(*place))).where(F.col("_upto") <= sample_bytes).select("_id", "_label")
    sample = rows.join(F.broadcast(fit_in), rows.doc_id == F.col("_id")).groupBy("_id").agg(F.max("_label").alias("label"), F.min("text").alias("text"))
    return sample.repartition(1).sortWithinPartitions(*place).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8_000, sample_bytes: int = 48 << 20) -> Model:
    """The model fitted on ``sampled``, in one task; only the weights reach the driver."""
    sample = sampled(docs, labels, label_col, id_col, text_col, sample_rows, sample_bytes)
    found = sample.mapInArrow(_fitted, "weights binary, bias double, slope double, shift double").collect()
    if not found:
        return fit(pa.array([], pa.string()), np.zeros(0, np.int64))
    return Model(np.frombuffer(found[0].weights, float), found[0].bias, found[0].slope, found[0].shift)


@tidy
def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (label, text) of a partition, as one row."""
    held = list(batches)
    if sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        del held
        model = fit(table.column("text").combine_chunks(), np.asarray(table.column("label").combine_chunks()).astype(np.int64))
        yield pa.record_batch({"weights": pa.array([np.asarray(model.weights, float).tobytes()], pa.binary()), "bias": pa.array([float(model.bias)]), "slope": pa.array([float(model.slope)]), "shift": pa.array([float(model.shift)])})


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; a text without words (null, empty, blank) has the score of no features."""
    rows = ids_and_texts(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            yield pa.record_batch({"doc_id": chunk.column("doc_id").combine_chunks(), "score": pa.array(held.value.scores(chunk.column("text")))})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores ``least`` or more; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, column=text_col):
            yield from chunk.filter(pa.array(held.value.scores(chunk.column(at)) >= least)).to_batches()

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLES: dict[str, str] = {}
