"""Token ids as Parquet list columns.

Layout: rows in ascending id order over files that follow each other, each file from one
task's range; ids as list<int> with dictionary encoding (few distinct values in a page),
the metadata columns delta-encoded (data page version 2); row groups and pages of a set
size, with column and offset indexes, so that a reader fetches the metadata columns alone,
or the ids of a few rows without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ids_and_texts, kept, partitions, shared_dir, small_batches, text_chunks, tidy
from .presplit import PieceEncoder, Vocabulary

def library_encoder(path: str) -> PieceEncoder:
    """Texts to ids by the tokenizers library, asked once for each piece that the cache doesn't hold."""
    return kept(("library", path), lambda: _library_encoder(path))


def _library_encoder(path: str) -> PieceEncoder:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        counts = np.zeros(len(pieces), np.int64)
        for a in range(0, len(pieces), 256):
            part = tokenizer.encode(pieces[a : a + 256], is_pretokenized=True, add_special_tokens=False)
            ids += part.ids
            counts[a : a + 256] = np.bincount(np.array(part.word_ids, np.int64), minlength=len(pieces[a : a + 256]))
        return np.array(ids, np.int32), counts

    return PieceEncoder(Vocabulary(path).added, encode)


def _encoded(path: str, end: int | None):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        part = TaskContext.get().partitionId()
        row = 0
        for chunk in text_chunks(batches, 2 << 20):
            ids, counts = encoder([t or "" for t in chunk.column("text").to_pylist()])
            if end is not None:
                ids = np.insert(ids, np.cumsum(counts), end)
                counts = counts + 1
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))
            n = len(counts)
            yield pa.record_batch({"part": pa.array(np.full(n, part, np.int32)), "row": pa.array(np.arange(row, row + n)), "doc_id": chunk.column("doc_id").combine_chunks(), "n_tokens": pa.array(counts), "ids": lists})
            row += n

    return run


def write_tokens(docs: DataFrame, out: str, path: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Write the token ids of every text, in ascending id order (null ids first; rows with equal ids by text).

    Columns: part (the file's place in the order), row (place in the file), doc_id, n_tokens
    and ids (list of int; with ``end`` appended if given). Null and empty texts have only
    the end id. The text is dealt once, by ranges of the id, and encoded where it lands.
    """
    rows = ids_and_texts(docs, id_col, text_col)
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    schema = f"part int, row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>"
    options = {
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "false",  # delta for the metadata
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.dictionary.page.size": 1 << 20,
        "parquet.page.row.count.limit": 20_000,
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": 1,
    }
    dealt.mapInArrow(_encoded(path, end), schema).write.options(**options).parquet(out)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, doc_id, n_tokens, start: ids of all rows before): reads no ids.

    Files' totals, one row for each file, are summed by a window over a small table; the
    sums inside a file are made in its own task.
    """
    meta = spark.read.parquet(path).select("part", "row", "doc_id", "n_tokens")
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = meta.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(F.col("part").alias("_part"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return meta.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, F.col("part") == F.col("_part")).select("part", "row", "doc_id", "n_tokens", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"))


@tidy
def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offsets = np.asarray(ids.offsets)
        flat = np.asarray(ids.values).astype("<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        yield pa.record_batch({"part": batch.column(0), "row": batch.column(1), "doc_id": batch.column(2), "n_tokens": pa.array(np.diff(offsets).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from the written ids."""
    rows = spark.read.parquet(path).select("part", "row", "doc_id", "ids")
    crc = rows.mapInArrow(_checksums, f"part int, row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(F.col("part").alias("_part"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    upto = crc.withColumn("upto", F.sum("n_tokens").over(inside))
    return upto.join(F.broadcast(before), F.col("part") == F.col("_part")).select("doc_id", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = shared_dir(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return read_checked(spark, out)


QUERIES = {"op3_token_id_output": op3_token_id_output}
ORACLES: dict[str, str] = {}
