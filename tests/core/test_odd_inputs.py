"""Queries against their SQL on tables that hold what the given ones rarely do."""

import duckdb
import pytest

from ledgerloom.plans import catalog
from test_queries import rows


def same_as_sql(spark, folder, name, **tables):
    """Whether the query equals its SQL on tables of (schema, rows)."""
    con = duckdb.connect()
    for t, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, str(folder)), con.execute(catalog.oracle_sql()[name])
    found = rows(got.columns, got.collect())
    assert found[1] and found == rows([x[0] for x in want.description], want.fetchall())


def test_sentences_with_any_space_around_them(spark, tmp_path):
    texts = [(1, "One.\u00a0\nTwo \u3000three. \u2003 Four"), (2, "\u00a0\n\u202f"), (3, "\tTab."), (4, None)]
    same_as_sql(spark, tmp_path, "doc_sentences", documents=spark.createDataFrame(texts, "doc_id long, text string"))


def test_evidence_beyond_the_thousandth_fragment(spark, tmp_path):
    documents = spark.createDataFrame([(k, "A b. " * 1500) for k in (4, 400, 996, 997, 998, 999)], "doc_id long, text string")
    same_as_sql(spark, tmp_path, "evidence_spans", documents=documents)
