"""Corpus pipeline: quality, near-duplicates, repeated passages, test leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; what it returns is written as Parquet and read again as the
next stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, decontaminate, quality, simhash, substrings
from codeloom.llm.staging import stage, table

RANKS = "byte_bpe_50k.tiktoken"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled texts vote to be good."""
    return quality.score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row in a column of its own, written once so that it stays the same."""
    row = name
    while row in docs.columns:
        row += "_"
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, and of those with the smallest text.

    Rows are told apart by a number of their own, not by their ids: rows of one id
    whose texts are no near-duplicates all stay, and rows without an id are
    compared like the others; they stand behind those with one.
    """
    numbered, row = _numbered(docs, "_row")
    groups = simhash.near_duplicates(numbered, shingle=4, bits=4, id_col=row).select(row, F.col("component_id").alias("_component"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.sha2(F.col("text").cast("binary"), 256), F.col(row).alias("_kept"))
    first = numbered.select(row, order.alias("_order")).join(groups, row).groupBy("_component").agg(F.min("_order").alias("_order"))
    return numbered.join(first.select(F.col("_order._kept").alias(row)), row, "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that an earlier document has; untouched texts stay as they are.

    A document of which nothing is left goes.
    """
    cut = substrings.remove_repeats(docs, window=13)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item by 0.8 or more of its 5-word shingles, each judged by its own text."""
    numbered, row = _numbered(docs, "_row")
    found = decontaminate.contaminated(numbered, table(spark, sf_dir, "benchmark"), id_col=row, shingle=5, threshold=0.8)
    return numbered.join(found.select(row).distinct(), row, "left_anti").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: Nearest-neighbour votes, fingerprints and merges have no SQL form; tests/llm/test_pipeline.py restates every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
