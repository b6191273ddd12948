"""Embedding whitening by MLlib's BlockMatrix.

Centred rows get gapless numbers and become a distributed matrix of blocks; its transpose times itself is the scatter
matrix, of which only dimension x dimension numbers reach the driver. There they are split into eigenvectors; the blocks
times the whitening matrix (eigenvectors over the roots of their eigenvalues) are the projected rows. The scatter of
those, in the same way, shows how far they are from white.

Entries are counted in whole steps of 1/1024, so sums and deviations are exact; a centred entry is (n x - S) / n, with the
difference exact, so it has the accuracy of a double however far the mean is from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, staged

SCALE, SHIFT = 1024, 100_000
#: Rows of a block. An entry's steps are held within what a double counts exactly.
BLOCK_ROWS, MOST_STEPS = 1024, 2.0**52
#: The driver holds a matrix of this many columns at most, 32 MB.
MOST_DIMENSIONS = 2048
#: An eigenvalue below this share of the largest is rounding, and its direction has no variance.
LEAST_SHARE = 1e-13


@dataclass(frozen=True)
class Whitening:
    """rows: (vec_id, index, x, and deviation, decimal(38), the sum of (n x - S)^2); n; sums S per dimension; eigenvalues, falling, of
    those kept; components, a column each; explained, their shares of the trace; projected: (index, whitened, an array)."""

    rows: DataFrame
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    projected: DataFrame

    def identity_error(self) -> float:
        """The largest absolute entry of the projected rows' covariance less the identity; 0 without rows or components."""
        k = len(self.eigenvalues)
        if not self.n or not k:
            return 0.0
        means = np.array(self.projected.select(*[F.avg(F.col("whitened")[j]) for j in range(k)]).first(), float)
        centred = self.projected.select("index", F.zip_with("whitened", _literal(means.tolist(), "double"), lambda w, m: w - m).alias("z"))
        cov = scatter(blocks(centred, self.n, k), partitions(self.rows.sparkSession)) / self.n
        return float(np.abs(cov - np.eye(k)).max())


def _literal(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x: the entries in steps, as longs) of rows whose vector isn't null and has neither null nor non-finite entries."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v"))
    # NaN and infinite entries are no smaller than the infinity
    good = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    steps = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(MOST_STEPS)), F.lit(-MOST_STEPS))) + SHIFT
    return rows.where(F.col("v").isNotNull() & good).select("vec_id", F.transform("v", steps).alias("x"))


def indexed(rows: DataFrame) -> DataFrame:
    """rows with ``index``, gapless from 0: each partition's number and each row's place in it are written down once, so a
    partition that is made again keeps its numbers; a count for each partition reaches the driver."""
    placed = staged(rows.withColumn("_id", F.monotonically_increasing_id()), "whitening")
    part, place = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    begin, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        begin.append(total)
        total += counts.get(k, 0)
    base = F.get(_literal(begin, "bigint"), part) if begin else F.lit(0).cast("long")
    return placed.withColumn("index", base + place).drop("_id")


def blocks(rows: DataFrame, n: int, columns: int) -> BlockMatrix:
    """(index, z: array of doubles) as a distributed matrix in blocks of BLOCK_ROWS rows; numbers go from 0 to n - 1."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("index").cast("long").alias("index"), array_to_vector("z").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, columns).toBlockMatrix(BLOCK_ROWS, columns)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """The matrix's transpose times itself. The rows are cut into ``splits`` parts, each part's products are added up where they are made."""
    model = lambda m: m._java_matrix_wrapper._java_model
    whole = BlockMatrix(matrix.transpose()._java_matrix_wrapper.call("multiply", model(matrix), splits), matrix.colsPerBlock, matrix.colsPerBlock)
    return whole.toLocalMatrix().toArray()


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> Whitening:
    """Fit on all usable rows of table and project each of them.

    Rows with a null vector, a null or non-finite entry are left out, and so are those whose length isn't
    the commonest one (ties: the longest), empty vectors among them. An entry c counts as floor(1024 c) + 100000, held
    within +-2^52. Equal rows stay, each with a number of its own; null and repeated ids too. Components without variance
    (fewer distinct rows than dimensions; one row; equal rows) can't be whitened and are left out. Eigenvalues that are
    equal share a plane, in which any two components at right angles will do. Without usable rows everything is empty.
    """
    spark = table.sparkSession
    found = usable(table, id_col, vector_col)
    sizes = found.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    d, n = (common.d, common.n) if common else (0, 0)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; the driver holds the scatter matrix of {MOST_DIMENSIONS} at most")
    rows = indexed(found.where(F.size("x") == d) if d else found.where("false"))
    if not n:
        none = spark.createDataFrame([], "index long, whitened array<double>")
        return Whitening(rows.withColumn("deviation", F.lit(0).cast("decimal(38,0)")), 0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), none)
    entries = rows.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.min("c").alias("low"), F.max("c").alias("high"))
    by_dimension = {r.k: (int(r.s), r.low, r.high) for r in entries.collect()}
    sums = [by_dimension[k][0] for k in range(d)]
    most = max(max(n * high - s, s - n * low) for s, low, high in by_dimension.values())
    # longs where the greatest square fits d times, decimals beyond
    kind = "bigint" if d * most * most < 1 << 63 and max(map(abs, sums)) < 1 << 62 else "decimal(38,0)"
    apart = F.zip_with("x", _literal(sums, kind), lambda c, s: c.cast(kind) * F.lit(n).cast(kind) - s)
    squares = F.aggregate(F.transform(apart, lambda a: (a * a).cast(kind)), F.lit(0).cast(kind), lambda t, a: (t + a).cast(kind))
    centred = F.transform(apart, lambda a: a.cast("double") / F.lit(float(n)))
    matrix = blocks(rows.select("index", centred.alias("z")), n, d)
    values, vectors = np.linalg.eigh(scatter(matrix, partitions(spark)) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > LEAST_SHARE * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    explained = values[:k] / values.sum() if k else values[:0]
    rows = rows.withColumn("deviation", squares.cast("decimal(38,0)"))
    if not k:
        return Whitening(rows, n, sums, values[:0], vectors[:, :0], explained, rows.select("index", F.array().cast("array<double>").alias("whitened")))
    weights = vectors[:, :k] / np.sqrt(values[:k])
    by_columns = DenseMatrix(d, k, weights.flatten("F").tolist())
    white = matrix.multiply(BlockMatrix(spark.sparkContext.parallelize([((0, 0), by_columns)], 1), d, k))
    projected = callMLlibFunc("getIndexedRows", white.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    projected = staged(projected.select("index", vector_to_array("vector").alias("whitened")), "whitening")
    return Whitening(rows, n, sums, values[:k], vectors[:, :k], explained, projected)


def by_component(fit: Whitening) -> DataFrame:
    """A row for each usable row and component: (vec_id, component, n, deviation, whitened, explained, identity_error).
    A deviation beyond a long's range is null."""
    error = fit.identity_error()
    both = fit.rows.select("index", "vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation")).join(fit.projected, "index")
    each = both.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share = F.get(_literal([float(x) for x in fit.explained], "double"), F.col("k")) if len(fit.explained) else F.lit(None).cast("double")
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLES: dict[str, str] = {}
