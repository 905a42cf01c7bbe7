"""Exact dedup by content-defined chunk recipes (native).

A text is cut where its own content says so: after a space that follows one of a few letters, once a chunk has
MIN_CHUNK characters, and at MAX_CHUNK at the latest. An insertion moves only the cuts around it, so long texts share
chunks. Each chunk gets a 128-bit identifier; the chunk store, which moves every chunk's text once and sums up repeats
before the shuffle, verifies that no identifier stands for two chunks (else all identifiers are taken from other seeds).
With verified identifiers two texts are equal exactly if their ordered identifier lists (recipes) are, so documents are
grouped by recipes and long texts never move again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import one_spaced, staged, table, whole

MIN_CHUNK, MAX_CHUNK = 512, 8192
#: A cut may follow a space after one of these characters.
CUT_AFTER = "[.nsre。！？]"
TEXT_CUTS = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<={CUT_AFTER} )|.{{1,{MAX_CHUNK}}}"


def chunks(text: Column) -> Column:
    """The text's chunks in order; joined they are the text again. None for the empty text."""
    return F.regexp_extract_all(text, F.lit(TEXT_CUTS), F.lit(0))


def chunk_id(chunk: Column, seed: int) -> Column:
    """128 bits, as two longs from independent seeds."""
    return F.array(F.xxhash64(F.lit(2 * seed), chunk), F.xxhash64(F.lit(2 * seed + 1), chunk))


def chunk_store(documents: DataFrame, seed: int = 0) -> DataFrame:
    """Each distinct chunk once: chunk_id array<bigint>, chunk, uses. Equal chunks are summed up before the shuffle."""
    parts = documents.select(F.explode(chunks(one_spaced(whole("text")))).alias("chunk"))
    return parts.groupBy(chunk_id(F.col("chunk"), seed).alias("chunk_id"), "chunk").agg(F.count("*").alias("uses"))


def verified_seed(documents: DataFrame) -> int:
    """The first seed whose identifiers tell all distinct chunks of these documents apart."""
    seed = 0
    while chunk_store(documents, seed).groupBy("chunk_id").count().filter("count > 1").limit(1).count():
        seed += 1
    return seed


def recipes(documents: DataFrame, seed: int) -> DataFrame:
    """doc_id, text_sha256 and recipe (identifiers of the text's chunks in order) of each document."""
    text = one_spaced(whole("text"))
    return documents.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.sha2("text", 256).alias("text_sha256"),
        F.flatten(F.transform(chunks(F.col("text")), lambda c: chunk_id(c, seed))).alias("recipe"),
    )


def exact_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents (doc_id, text).

    Texts are equal when identical after each run of ASCII white space became one space. Null counts as the empty text;
    all empty texts are one group. Of a group the smallest doc_id stays. Rows that repeat a doc_id and text are each
    returned and counted, and have the same verdict. A null doc_id never stays where its group has another one. Other
    columns are ignored. No documents: no rows. Groups of any size: the group sizes are pre-aggregated before they are
    shuffled, and the join back is one whose hot partitions Spark splits.
    """
    documents = documents.select("doc_id", "text")
    found = staged(recipes(documents, verified_seed(documents)), "recipes")
    groups = found.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return found.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
