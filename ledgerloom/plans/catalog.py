"""All queries of the library with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import anchor_queries, assess_queries, contract_queries, decision_queries, extract_queries, fold_queries, graph_queries, join_queries, ledger_queries, match_queries, mutation_queries, score_queries, similar_queries, stream_queries, temporal_queries, text_queries

MODULES = (text_queries, contract_queries, fold_queries, similar_queries, temporal_queries, extract_queries, anchor_queries, match_queries, graph_queries, ledger_queries, decision_queries, assess_queries, mutation_queries, join_queries, score_queries, stream_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, their faults and quality scores by language."""
    return text_queries.doc_quality_by_lang(spark, sf_dir)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
