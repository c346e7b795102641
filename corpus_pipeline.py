"""From raw documents to packed training sequences.

Each stage takes the documents that the one before has kept and returns those that it keeps, with the
columns of ``documents``; the last returns the pieces of the packed sequences, with their ids.

1. language ID drops documents without letters and those whose language can't be told;
2. line dedup deletes lines that are later copies of repeated runs, and drops documents left without words;
3. SimHash near-dedup keeps one document of each group;
4. secret scans replace secrets by a placeholder;
5. packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import language_id, line_dedup, packing, secret_scan, simhash
from tabloom.llm.common import SPACES, written


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = language_id.train(docs.where(F.coalesce(learned, F.lit(True))))
    return language_id.keep_identified(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.drop_repeated_lines(docs, removed="ld_removed")
    emptied = (F.size("ld_removed") > 0) & ~F.col("text").rlike(f"[^{SPACES}]")
    return _with_length(clean.where(~F.coalesce(emptied, F.lit(False))).drop("ld_removed"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle_words=4, max_distance=4)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(secret_scan.redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("secret_scan", redact),
    ("packing", pack),
]

#: Fitted models, fingerprints and packing have no SQL form; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
