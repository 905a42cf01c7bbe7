"""Queries that run as streams over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators.joins import placed
from ledgerloom.session import dealt, shared_dir, staged
from ledgerloom.sources.tables import table
from ledgerloom.streaming import ledger_stream as S, plan_log

QUERIES, SQL = {}, {}


def stream_window_counts(spark, sf):
    return S.once(S.window_counts(S.event_stream(spark, f"{sf}/events.parquet*"), "6 hours", "1 day"), shared_dir(spark), "complete")


QUERIES["stream_window_counts"] = stream_window_counts
SQL["stream_window_counts"] = """SELECT CAST(epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01')) AS BIGINT) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""


def stream_first_events(spark, sf):
    firsts = S.first_of_each(S.event_stream(spark, f"{sf}/events.parquet*"), ["event_id"], "1 day")
    return S.once(firsts.select("event_id", "user_id", "event_type"), shared_dir(spark), "append").select("event_id", "user_id", "event_type")


QUERIES["stream_first_events"] = stream_first_events
SQL["stream_first_events"] = "SELECT event_id, user_id, event_type FROM events"


# ---- the log of plans: every workspace (a customer's remainder) has its orders' lines as operations, five to a plan

OPERATIONS = """lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey % 40 AS w, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def plan_entries(spark, sf):
    # Lines are dealt by rows and numbered in ranges of their order, so that no task sorts a whole workspace. Lines that differ by
    # their price alone give the same operations whichever comes first.
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    count = lines.count()
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 40).alias("w"))
    lines = dealt(lines, count, "l_orderkey").join(orders, "l_orderkey")
    by = [F.col(c).asc_nulls_last() for c in ("w", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    rows = placed(lines, count, by, ["w", "l_suppkey", "l_partkey"], "plan-lines")
    firsts = staged(rows.groupBy("w").agg(F.min("place").alias("first")), "plan-firsts").withColumnRenamed("w", "of")
    rows = rows.join(F.broadcast(firsts), F.col("w").eqNullSafe(F.col("of"))).withColumn("n", F.col("place") - F.col("first") + 1)
    rows = staged(rows.select("w", "n", "l_suppkey", "l_partkey"), "plan-operations")  # every batch reads them
    # Every seventh workspace leaves a number out behind the 60th; every eleventh operation repeats the one before it.
    seq = F.col("n") + F.when((F.col("w") % 7 == 0) & (F.col("n") > 60), 1).otherwise(0)
    key = F.concat_ws("-", "w", F.when(F.col("n") % 11 == 0, F.col("n") - 1).otherwise(F.col("n")))
    op = F.element_at(F.array(*map(F.lit, ("CREATE_ASSERTION", "PROJECT_RELATION", "CREATE_ASSERTION", "SUPERSEDE_ASSERTION", "PROJECT_RELATION"))), ((F.col("n") - 1) % 5 + 1).cast("int"))
    return rows.select(
        F.col("w").cast("string").alias("workspace"), F.concat_ws("/", "w", F.floor((F.col("n") - 1) / 5)).alias("plan_id"), seq.cast("long").alias("seq"), key.alias("op_key"), op.alias("op"),
        F.concat_ws("-", "w", F.col("n") - F.when(F.col("n") % 5 == 4, 3).otherwise(0)).alias("assertion_id"), F.concat_ws("-", "w", "n").alias("other_id"), F.col("l_suppkey").cast("string").alias("subject"), F.col("l_partkey").cast("string").alias("object"), F.col("n").cast("long").alias("at"),
    )


def plan_log_outcomes(spark, sf):
    """Three batches, the second of which comes twice."""
    path = f"{shared_dir(spark)}/plan-log-{uuid.uuid4().hex}"
    rows = plan_entries(spark, sf)
    batch = F.least(F.floor((F.col("at") - 1) / 50), F.lit(2))
    for number in (0, 1, 1, 2):
        plan_log.append(rows.filter(batch == number), number, path)
    return plan_log.read_log(spark, path).select("workspace", "seq", "op_key", "outcome", "reason", "batch")


QUERIES["plan_log_outcomes"] = plan_log_outcomes
SQL["plan_log_outcomes"] = f"""WITH {OPERATIONS}, e AS (SELECT *, n + CASE WHEN w % 7 = 0 AND n > 60 THEN 1 ELSE 0 END AS seq, CASE WHEN n % 11 = 0 THEN n - 1 ELSE n END AS key, w % 7 = 0 AND n > 60 AS late FROM lines)
SELECT w::VARCHAR AS workspace, seq, w || '-' || key AS op_key, CASE WHEN late THEN 'refused' WHEN key < n THEN 'skipped' ELSE 'applied' END AS outcome,
  CASE WHEN late THEN CASE WHEN n = 61 OR n = 101 THEN 'SEQUENCE_GAP' WHEN n BETWEEN 62 AND 65 OR n BETWEEN 102 AND 105 THEN 'SEQUENCE_GAP' ELSE 'AFTER_REFUSED' END WHEN key < n THEN 'ALREADY_APPLIED' END AS reason, least((n - 1) // 50, 2) AS batch FROM e"""


def plan_log_assertions(spark, sf):
    path = f"{shared_dir(spark)}/plan-log-{uuid.uuid4().hex}"
    plan_log.append(plan_entries(spark, sf), 0, path)
    return plan_log.assertions(plan_log.read_log(spark, path)).select("assertion_id", "status", "valid_from", "valid_to", "superseded_by")


QUERIES["plan_log_assertions"] = plan_log_assertions
SQL["plan_log_assertions"] = f"""WITH {OPERATIONS}, e AS (SELECT * FROM lines WHERE NOT (w % 7 = 0 AND n > 60) AND n % 11 <> 0), made AS (SELECT w, n FROM e WHERE n % 5 IN (1, 3)), ends AS (SELECT w, n, n - 3 AS old FROM e WHERE n % 5 = 4)
SELECT m.w || '-' || m.n AS assertion_id, CASE WHEN x.n IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, m.n AS valid_from, x.n AS valid_to, CASE WHEN x.n IS NOT NULL THEN x.w || '-' || x.n END AS superseded_by FROM made m LEFT JOIN ends x ON x.w = m.w AND x.old = m.n"""
