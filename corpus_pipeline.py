"""The corpus pipeline: from raw documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) and calls one operator over all that the stage before it kept; its result
is written as Parquet and read again by the next. All stages but the last return the columns of documents, and n_chars
follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import line_dedup, near_dedup, packing, pii, quality_rules
from ledgerloom.llm.common import staged, table


def counted(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, n_chars counted anew where there is one."""
    if "n_chars" in columns:
        documents = documents.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return documents.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; a document that loses all of them stays, empty."""
    return counted(line_dedup.line_dedup(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes the name of its kind in brackets."""
    return counted(pii.redact(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    return packing.pack(docs, *packing.vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: SQL can express neither the learned verdicts nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
