"""Conversations in order, in partitions of bounded size, for the operators that read turns one after the other.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is cut into pieces,
one for each partition that it reaches. Only the first and the last conversation of a partition can go on
elsewhere: their pieces are marked ``edge``, all other conversations are whole where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, tidy


def in_order(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, ...) sorted by conversation and turn over partitions, nulls first; equal
    turns by role, then by a hash of the text. Rows that are equal in all of these are dealt as they come."""
    keyed = rows.withColumn("_text", F.xxhash64("text")).withColumn("_row", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "_text", "_row")]
    return keyed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).drop("_text", "_row")


def conversation_runs(batches: Iterator[pa.RecordBatch], by: str = "conv_id") -> Iterator[tuple[object, dict[str, list], bool]]:
    """(id, the columns of its rows, whether its partition begins or ends with it), one conversation held at a time."""
    held: dict[str, list] | None = None
    now, first = None, True
    for batch in batches:
        columns = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
        ids = columns[by]
        cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held is not None and ids[a] == now:
                for name, values in columns.items():
                    held[name] += values[a:b]
                continue
            if held is not None:
                yield now, held, first
                first = False
            now, held = ids[a], {name: values[a:b] for name, values in columns.items()}
    if held is not None:
        yield now, held, True


def digests(pieces: DataFrame, columns: dict[str, str], skip: int = 0) -> DataFrame:
    """(conv_id, a SHA-256 for each of ``columns``, which maps result names to string columns of pieces): over each
    conversation's pieces in order of ``piece``, without the first ``skip`` bytes. A digest is sequential, so one task
    reads all pieces of a conversation, but one piece at a time."""
    names = list(columns)
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{n} string' for n in names)}"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, states = None, False, []
        done: list[tuple] = []
        id_type = pa.null()

        def flushed():
            out = pa.record_batch([pa.array([d[0] for d in done], id_type), *[pa.array([d[1][k] for d in done], pa.string()) for k in range(len(names))]], ["conv_id", *names])
            done.clear()
            return out

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            ids = batch.column(0).to_pylist()
            for r, conv in enumerate(ids):
                if not begun or conv != now:
                    if begun:
                        done.append((now, [s.hexdigest() for s, _ in states]))
                    now, begun, states = conv, True, [[hashlib.sha256(), skip] for _ in names]
                for k, state in enumerate(states):
                    raw = batch.column(1 + k)[r].as_buffer()
                    raw = memoryview(raw) if raw is not None else memoryview(b"")
                    state[0].update(raw[state[1] :])
                    state[1] = max(0, state[1] - len(raw))
            if len(done) >= 1000:
                yield flushed()
        if begun:
            done.append((now, [s.hexdigest() for s, _ in states]))
            yield flushed()

    chosen = pieces.select("conv_id", *[F.col(c).alias(n) for n, c in columns.items()], F.col("piece").alias("_piece"))
    placed = chosen.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "_piece")
    return placed.drop("_piece").mapInArrow(run, schema)


def beside(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("conv_id",), how: str = "inner") -> DataFrame:
    """A join on columns of the same names, null ids equal; the columns are there once."""
    named = right.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in right.columns if c not in by])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return left.join(named, on, how).drop(*[f"_{c}" for c in by])


def joined(pieces: DataFrame, text: str) -> Column:
    """A string column of a conversation's pieces, in order, as an aggregate."""
    ordered = F.array_sort(F.collect_list(F.struct("piece", F.col(text).alias("part"))))
    return F.array_join(F.transform(ordered, lambda x: x["part"]), "")
