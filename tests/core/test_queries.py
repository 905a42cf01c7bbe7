"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from ledgerloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    def cell(v):
        return "~" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(cell(r[k]) for k in order) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got, want = catalog.queries()[name](spark, SF), db.execute(catalog.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([x[0] for x in want.description], want.fetchall())
