"""From raw documents to token ids: five stages, each over all that its predecessor kept.

1. quality classifier: documents that score below 0.3 go;
2. SimHash near-dedup: of each group of near copies, linked by either of two fingerprints, the row with the smallest id stays;
3. suffix-array dedup: every byte covered by a 50-byte string that also starts in a document
   with a smaller id goes, and what is left of code points that this cuts (the document stays,
   with an empty text if nothing is left);
4. benchmark decontamination: documents go in which at least one word in twenty is part of a
   benchmark window;
5. BPE encoding and decoding: token ids of each text, and checksums of ids and decoded text.

Each stage's function takes (spark, docs, sf_dir); docs has the columns of documents, and all
stages but the last return them. Rows with a null id stay as they are in stage 2; rows that
repeat an id are told apart there by their texts, so each stays or goes with its own group, and
of a group's rows with the smallest id one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import bpe, decontaminate, quality, simhash, suffixes
from cardloom.llm.common import discard, small_batches, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs.select(COLUMNS), model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    key = ["doc_id", "_text"]
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    found = simhash.near_duplicate_groups(rows, carry=["_text"], prints=2).where("doc_id IS NOT NULL")
    groups = staged(found.select("doc_id", "carried._text", "component", "component_id"), "copies")
    again = groups.where("doc_id = component_id").groupBy("doc_id", "component").agg(F.min("_text").alias("_first"), F.count("*").alias("n")).where("n > 1")
    later = groups.join(again, ["doc_id", "component"]).where("_text <> _first")
    copies = groups.where("doc_id <> component_id").select(key).unionByName(later.select(key)).distinct()
    kept = rows.join(copies, key, "left_anti")
    if not again.isEmpty():
        firsts = again.select("doc_id", F.col("_first").alias("_text"))
        kept = kept.join(firsts, key, "left_anti").unionByName(kept.join(firsts, key, "left_semi").dropDuplicates(key))
    return kept.select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = suffixes.repeats_removed(docs, carry=["lang", "source"], as_text=True)
    return found.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["lang", "source", "n_chars"])
    return found.where(~decontaminate.contaminated()).select("doc_id", "text", "carried.lang", "carried.source", "carried.n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = bpe.encoded_and_decoded(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.digests(rows)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("bpe encoding and decoding", token_ids),
]

#: No SQL can express the trained classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and those of the one before deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), "pipeline")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
