"""From raw documents to packed training sequences: each stage works on what the one before it kept.

Every stage but the last returns the columns of documents. There is no SQL for it: SQL cannot tokenize.

Defined results, for all stages: columns beyond those of documents are dropped; null and repeated doc_ids stay rows of their own; an empty table gives no
rows; texts of any length are judged, cleaned and packed whole. Null, empty and blank texts go with the first stage, as their counts fail its rules.
Of equal or near-equal lines and documents the one of the smallest doc_id stays (null first, ties by a hash of the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from tessera.llm.shared import small_batches, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR = jaccard_join.Likeness(5, 8, 10)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    return quality_rules.judge(docs).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents less repeated lines; those that lose every word go."""
    small_batches(spark)
    out = line_dedup.dedup_lines(docs).where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard >= 0.8."""
    small_batches(spark)
    return jaccard_join.keep_one(docs, NEAR).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with the checksum of their ids."""
    small_batches(spark)
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontaminate", benchmark), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
