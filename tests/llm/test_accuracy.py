"""Held-out accuracy, brute force on the small tables, and SQL where it can be written."""

import collections
import os

import duckdb
import pytest
from pyspark.sql import Window, functions as F

from ledgerloom.llm import exact_dedup, near_dedup, registry, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    key = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_near_dedup_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    sets = {}
    for i, text in zip(docs.doc_id, docs.text):
        w = (text or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == {i: find(i) for i in sets}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op1_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    seen = collections.Counter(zip(held.predicted, held.toxic))
    assert seen[1, 1] / (seen[1, 1] + seen[0, 1]) > 0.8 and seen[1, 0] / (seen[1, 0] + seen[0, 0]) < 0.02


def test_recipes_tell_texts_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert exact_dedup.verified_seed(docs) == 0


def test_toxicity_learns_from_every_label(spark):
    rows = spark.range(6000).withColumn("toxic", (F.col("id") < 3000).cast("int")).withColumn("lang", F.lit("en"))
    turn = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id"))
    # A word that only the last toxic documents by hash have.
    word = F.when(F.col("toxic") == 0, "mild").when(turn > 2200, "foul").otherwise("vile")
    rows = rows.withColumn("text", F.concat_ws(" ", F.lit("some words about"), F.col("id").cast("string"), word)).withColumnRenamed("id", "doc_id").localCheckpoint()
    got = toxicity.toxicity(rows.select("doc_id", "text", "lang"), rows.select("doc_id", "toxic")).filter("held_out").join(rows.select("doc_id", "text", "toxic"), "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.98 and got.predicted[got.text.str.endswith("foul")].mean() > 0.98
