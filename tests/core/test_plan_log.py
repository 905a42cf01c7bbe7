"""The log of plans: gaps, repeats, interlaced plans, batches that come again, and a stream."""

import tempfile

from ledgerloom.streaming import plan_log


def entries(spark, *rows):
    """rows: (workspace, plan, seq, key, op, assertion, other)."""
    return spark.createDataFrame([(*r[:5], *(*r[5:], None, None)[:2], "s", "o", r[2]) for r in rows], plan_log.ENTRY)


def outcomes(log):
    return sorted((r.workspace or "", r.seq or 0, r.op_key or "", r.outcome, r.reason) for r in log.collect())


def test_gaps_repeats_and_whole_plans(spark):
    path = tempfile.mkdtemp(prefix="ledgerloom-log-") + "/log"
    plan_log.append(entries(spark, ("w", "p1", 1, "a", "X"), ("w", "p1", 2, "b", "X"), ("v", "q", 2, "z", "X"), ("w", None, 9, "n", "X")), 0, path)
    assert outcomes(plan_log.read_log(spark, path)) == [("v", 2, "z", "refused", "SEQUENCE_GAP"), ("w", 1, "a", "applied", None), ("w", 2, "b", "applied", None), ("w", 9, "n", "refused", "INCOMPLETE")]
    second = entries(
        spark, ("w", "p1", 2, "b", "X"), ("w", "p2", 3, "a", "X"), ("w", "p2", 4, "c", "X"), ("w", "p3", 5, "d", "X"), ("w", "p4", 6, "e", "X"), ("w", "p3", 7, "f", "X"), ("w", "p4", 9, "g", "X"), ("w", "p5", 10, "h", "X"),
        ("v", "q", 1, "y", "X"), ("v", "q", 2, "y", "X"), ("v", "r", 3, "x", "X"),
    )
    plan_log.append(second, 1, path)
    want = [
        ("v", 1, "y", "applied", None), ("v", 2, "y", "skipped", "ALREADY_APPLIED"), ("v", 3, "x", "applied", None),
        ("w", 2, "b", "skipped", "ALREADY_APPLIED"), ("w", 3, "a", "skipped", "ALREADY_APPLIED"), ("w", 4, "c", "applied", None), ("w", 5, "d", "refused", "AFTER_REFUSED"),
        ("w", 6, "e", "refused", "SEQUENCE_GAP"), ("w", 7, "f", "refused", "AFTER_REFUSED"), ("w", 9, "g", "refused", "SEQUENCE_GAP"), ("w", 10, "h", "refused", "AFTER_REFUSED"),
    ]
    assert outcomes(plan_log.read_log(spark, path).filter("batch = 1")) == want
    whole = outcomes(plan_log.read_log(spark, path))
    plan_log.append(second, 1, path)  # the same batch again
    assert outcomes(plan_log.read_log(spark, path)) == whole
    plan_log.append(entries(spark, ("w", "p9", 4, "new", "X"), ("v", "s", 4, "m", "X"), ("v", "t", 4, "k", "X")), 2, path)
    assert outcomes(plan_log.read_log(spark, path).filter("batch = 2")) == [("v", 4, "k", "refused", "SEQUENCE_REPEATED"), ("v", 4, "m", "refused", "SEQUENCE_REPEATED"), ("w", 4, "new", "refused", "SEQUENCE_TAKEN")]
    plan_log.append(second.limit(0), 3, path)
    assert plan_log.read_log(spark, path).filter("batch = 3").count() == 0


def test_a_stream_and_what_it_leaves(spark):
    base = tempfile.mkdtemp(prefix="ledgerloom-log-")
    first = entries(spark, ("w", "p1", 1, "a", "CREATE_ASSERTION", "A"), ("w", "p1", 2, "b", "PROJECT_RELATION", "A"), ("w", "p2", 3, "c", "CREATE_ASSERTION", "B"))
    second = entries(spark, ("w", "p3", 4, "d", "CREATE_ASSERTION", "C"), ("w", "p3", 5, "e", "SUPERSEDE_ASSERTION", "A", "C"), ("w", "p3", 6, "f", "PROJECT_RELATION", "C"), ("w", "p4", 7, "g", "CLOSE_VALIDITY", "B"), ("w", "p5", 8, "h", "CLOSE_VALIDITY", "Z"))
    for rows in (first, second):
        rows.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(plan_log.ENTRY).parquet(f"{base}/in")
        plan_log.follow(stream, f"{base}/log", f"{base}/state").awaitTermination()
    log = plan_log.read_log(spark, f"{base}/log")
    assert log.count() == 8 and log.filter("outcome = 'applied'").count() == 8
    got = {r.assertion_id: (r.status, r.valid_from, r.valid_to, r.superseded_by) for r in plan_log.assertions(log).collect()}
    assert got == {"A": ("SUPERSEDED", 1, 5, "C"), "B": ("ENDED", 3, 7, None), "C": ("ACTIVE", 4, None, None)}
    assert [r.assertion_id for r in plan_log.relations(log).collect()] == ["C"]
