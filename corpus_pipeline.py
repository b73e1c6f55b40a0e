"""The corpus pipeline: quality, near-duplicate documents, repeated paragraphs, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.llm import op03_substring_dedup, op04_quality, op07_jaccard_join, op10_packing
from lumigrid.llm.common import stash, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, columns as they were.

    Null and empty texts are scored like a text without characters; without labels all stay. Rows of one doc_id with several texts are judged one
    by one, equal rows alike. An empty table stays empty.
    """
    return op04_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, by (doc_id, text), columns as they were.

    Null texts, texts without words and rows without doc_id stay. Of rows that repeat doc_id and text one stays. An empty table stays empty.
    """
    return op07_jaccard_join.keep_first(docs)


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the paragraphs and runs of words that repeat an earlier one; n_chars follows the text.

    Null and empty texts, and rows without doc_id, stay as they are. Columns that ``docs`` has are kept, also those named like the operator's own.
    """
    held = unused(docs, *op03_substring_dedup.ADDED)
    made = op03_substring_dedup.dedup(docs.withColumnsRenamed(dict(zip(op03_substring_dedup.ADDED, held)))).drop(*op03_substring_dedup.ADDED)
    made = made.withColumnsRenamed(dict(zip(held, op03_substring_dedup.ADDED)))
    return made.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else made


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed along the curve; a null text has only the end id, repeated rows are packed one by one."""
    return op10_packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_paragraphs),
    ("packing", packing),
]

#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, "stage")
    return docs
