"""Sharding by a hierarchical weighted hash tree.

Every node below the root, region, rack and shard alike, has a draw of its own for each key:
-ln(u) / weight, with u from a hash of the key and the node's path and the weight of the whole
subtree. A key goes to the region with the smallest draw, there to the rack with the smallest,
there to the shard with the smallest. It so meets the nodes of three fan-outs, not all leaves.

A draw depends on the key, the node's path and the node's weight alone. So a change inside a
rack moves keys within that rack if its weight stays as it was, and else between racks of its
region and, by the share that the region's weight changes, between regions; inside all other
racks and regions nothing moves. A new shard in an old rack thus gets its keys with others that
come to its rack and region. To get rows into the new shard alone it opens a region of
its own (``extended``): no other subtree's weight changes then.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, regions: int = 2, racks: int = 3) -> list[Leaf]:
    """Shards 0 to ``shards`` - 1 of weight 1, dealt in turn to the racks of the regions; a shard's place never changes."""
    return [Leaf(s % regions, s // regions % racks, s) for s in range(shards)]


def extended(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, with the next number, in a region of its own: rows move into it only."""
    return [*leaves, Leaf(max((x.region for x in leaves), default=-1) + 1, 0, max((x.shard for x in leaves), default=-1) + 1, weight)]


def draw(key: Column, path: tuple[int, ...], weight: float) -> Column:
    """The exponential draw of a key (string) at a node: 53 bits of the hash of both make u in (0, 1]."""
    h = F.xxhash64(F.concat(key, F.lit("".join(f"/{k}" for k in path))))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 1.0) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def chosen(key: Column, nodes: dict[tuple[int, ...], float]) -> Column:
    """The last number of the node with the smallest draw (ties: the smallest number) among siblings."""
    if len(nodes) == 1:
        return F.lit(next(iter(nodes))[-1])
    return F.array_min(F.array(*[F.struct(draw(key, path, w).alias("draw"), F.lit(path[-1]).alias("node")) for path, w in sorted(nodes.items())]))["node"]


def descended(rows: DataFrame, key: str, leaves: list[Leaf], name: str) -> DataFrame:
    """rows with column ``name``, the shard of each key: one level after the other, a choice among the chosen
    node's children. Leaves need positive, finite weights; those of weight 0 are left out."""
    leaves = [x for x in leaves if x.weight > 0]
    if not leaves or any(not math.isfinite(x.weight) for x in leaves):
        raise ValueError("a tree needs leaves with positive, finite weights")
    at = ["_region", "_rack", name]
    for level in range(3):
        parents: dict[tuple[int, ...], dict[tuple[int, ...], float]] = {}
        for x in leaves:
            path = (x.region, x.rack, x.shard)[: level + 1]
            below = parents.setdefault(path[:-1], {})
            below[path] = below.get(path, 0.0) + x.weight
        out = None
        for parent, below in sorted(parents.items(), reverse=True):
            here = F.lit(True)
            for column, number in zip(at, parent, strict=False):
                here = here & (F.col(column) == number)
            out = chosen(F.col(key), below) if out is None else F.when(here, chosen(F.col(key), below)).otherwise(out)
        rows = rows.withColumn(at[level], out)
    return rows.drop("_region", "_rack")


def sharded(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    The id alone decides the shard (law ``key``); a null id counts as the empty string. size:
    UTF-8 bytes of the text (null: none) plus 8. slot: a gapless number from 0 in the shard; a
    shard's rows are cut into parts by a hash and numbered in each by (id, checksum, size),
    after the rows of the parts before, so no task holds a whole shard. Repeated rows get
    different slots. grown_shard: the shard in the tree ``grown``, else null.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), key.alias("_key"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = descended(rows, "_key", leaves, "shard")
    rows = descended(rows, "_key", grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    parts = max(1, math.ceil(4 * partitions(spark) / len(leaves)))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_key", "text_crc32"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "_part", (F.sum("n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("n")).alias("_base"))
    inside = Window.partitionBy("shard", "_part").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")
    # shards * parts rows, whatever the input
    placed = rows.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(before), ["shard", "_part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_base") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")


def op5_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), tree(24), extended(tree(24)))


QUERIES = {"op5_hash_tree_sharding": op5_hash_tree_sharding}
ORACLES: dict[str, str] = {}
