"""Partitions follow the number of rows, so that a task's memory does not grow with the table."""

from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import assess, joins
from ledgerloom.plans import score_queries


def test_a_decision_is_sorted_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "PARTITION_ROWS", 50)
    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") < 490, "REVIEW").otherwise("LATER").alias("decision"), (F.col("id") % 2 == 0).alias("disagree"), F.when(F.col("id") % 5 > 0, F.col("id") % 7 / 7).alias("confidence"))
    got = joins.priority(rows, ["REVIEW"])
    assert "row_number()" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(rows.collect(), key=lambda r: (r.decision != "REVIEW", not r.disagree, r.confidence is not None, r.confidence or 0, r.id))
    assert [r.id for r in got.orderBy("place").collect()] == [r.id for r in want] and [r.place for r in got.orderBy("place").collect()] == list(range(1, 501))
    assert not joins.priority(rows.limit(0), ["REVIEW"]).count()


def test_pairs_are_counted_in_partitions_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "PARTITION_ROWS", 1000)
    got = score_queries.co_mention_support(spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() > 10


def test_blocks_are_judged_text_by_text(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 71), (4, "x" * 72), (5, "é" * 80)], "id int, text string").coalesce(1)
    assert [r[1] for r in rows.select("id", assess.repeats_block(F.col("text"))).orderBy("id").collect()] == [False, False, False, True, True]
