"""Connected components of an edge table, without gathering it anywhere.

Alternating large-star and small-star rounds on DataFrames (Kiveris et al., "Connected
Components in MapReduce and Beyond"): each round is two shuffles on node ids, the number
of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, tidy


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component, for edges that fit in memory."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        before = parent.copy()
        low = np.minimum(parent[x], parent[y])
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        parent = parent[parent]
        if (parent == before).all():
            break
    keep = parent != np.arange(len(nodes))
    return nodes[keep], nodes[parent[keep]]


@tidy
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = forest(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def connected_components(edges: DataFrame, max_rounds: int = 60, contracted: bool = False) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b: long) and the smallest node it can reach.

    Nodes without an edge to another node are absent. Null ends and loops are ignored;
    repeated edges change nothing; an empty table gives an empty table. Each task's edges are
    reduced to a spanning forest first, unless they come as one (``contracted``).
    """
    now = edges.select("a", "b").where("a <> b")
    now = staged((now if contracted else now.mapInArrow(_contract, "a long, b long")).distinct(), "edges")
    last = None if now.take(1) else (0, None)
    for _ in range(max_rounds):
        if last == (0, None):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every neighbour that is smaller, and the node itself, go to the smallest neighbour
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        before, now = now, staged(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        discard(before)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000000007)).first())
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
