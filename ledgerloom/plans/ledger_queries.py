"""Queries on moves of the ledger, sealed chains, snapshots and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.scores import first_that
from ledgerloom.operators import ledger, moves
from ledgerloom.plans.graph_queries import LEDGER, entries, instant
from ledgerloom.session import staged
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# The ledger up to the 15th is the state; the first later event of each assertion is a command about it. The assertion that
# a command contradicts is the subject's first one by name.
COMMANDS = f"""{LEDGER},
cur AS (SELECT assertion_id, subject, arg_max(status, (recorded_at, seq)) AS was, arg_max(confidence, (recorded_at, seq)) AS held, count(*) AS revision FROM ledger WHERE recorded_at <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL),
twins AS (SELECT subject, count(*) AS live_twins FROM cur WHERE was NOT IN ('SUPERSEDED', 'RETRACTED') GROUP BY subject),
others AS (SELECT subject, min(assertion_id) AS other_id, arg_min(was, assertion_id) AS other_was, arg_min(held, assertion_id) AS other_held, arg_min(revision, assertion_id) AS other_revision FROM cur GROUP BY subject),
first AS (SELECT * EXCLUDE rk FROM (SELECT *, row_number() OVER (PARTITION BY assertion_id ORDER BY recorded_at, seq) AS rk FROM ledger WHERE recorded_at > TIMESTAMP '2024-01-15 00:00:00') WHERE rk = 1),
cmd AS (SELECT f.assertion_id, f.status AS new_status, f.confidence AS new_confidence, f.seq % 3 AS new_evidence, was, held, revision, coalesce(live_twins, 0) AS live_twins, other_id, other_was, other_held, other_revision,
  f.assertion_id || '+' AS successor_id, coalesce(was = 'ENDED', false) AS closed,
  CASE WHEN was IS NULL THEN 'assert' WHEN f.confidence < 0.05 THEN 'assert' WHEN f.confidence < 0.3 THEN 'confirm' WHEN f.confidence < 0.5 THEN 'supersede' WHEN f.confidence < 0.7 THEN 'contradict' WHEN f.confidence < 0.85 THEN 'retract' ELSE 'close' END AS operation
  FROM first f LEFT JOIN cur USING (assertion_id) LEFT JOIN twins ON f.subject = twins.subject LEFT JOIN others ON f.subject = others.subject)"""


def current(spark, sf):
    at = F.struct("recorded_at", "seq")
    rows = entries(spark, sf).filter(F.col("recorded_at") <= instant(15))
    return rows.groupBy("assertion_id", "subject").agg(F.max_by("status", at).alias("was"), F.max_by("confidence", at).alias("held"), F.count("*").alias("revision"))


def commands(spark, sf):
    cur = current(spark, sf)
    twins = cur.filter(~F.col("was").isin(ledger.TERMINAL)).groupBy("subject").agg(F.count("*").alias("live_twins"))
    other = F.min(F.struct("assertion_id", "was", "held", "revision")).alias("o")
    others = cur.groupBy("subject").agg(other).select("subject", F.col("o.assertion_id").alias("other_id"), F.col("o.was").alias("other_was"), F.col("o.held").alias("other_held"), F.col("o.revision").alias("other_revision"))
    later = entries(spark, sf).filter(F.col("recorded_at") > instant(15))
    first = later.groupBy("assertion_id", "subject").agg(F.min(F.struct("recorded_at", "seq", "status", "confidence")).alias("f"))
    rows = first.select("assertion_id", "subject", F.col("f.status").alias("new_status"), F.col("f.confidence").alias("new_confidence"), (F.col("f.seq") % 3).alias("new_evidence"))
    rows = rows.join(cur.drop("subject"), "assertion_id", "left").join(twins, "subject", "left").join(others, "subject", "left").fillna(0, ["live_twins"])
    c = F.col("new_confidence")
    operation = first_that((F.col("was").isNull() | (c < 0.05), "assert"), (c < 0.3, "confirm"), (c < 0.5, "supersede"), (c < 0.7, "contradict"), (c < 0.85, "retract"), otherwise="close")
    return rows.withColumn("operation", operation).withColumn("successor_id", F.concat("assertion_id", F.lit("+"))).withColumn("closed", F.coalesce(F.col("was") == "ENDED", F.lit(False)))


@query("ledger_moves", f"""WITH {COMMANDS}, r AS (SELECT *, CASE
  WHEN operation = 'assert' THEN CASE WHEN was IS NOT NULL THEN 'key_exists' WHEN new_status NOT IN ('PLANNED', 'ACTIVE') THEN 'status_not_initial' WHEN live_twins > 0 THEN 'live_duplicate' END
  WHEN was IN ('SUPERSEDED', 'RETRACTED') THEN 'terminal'
  WHEN operation = 'confirm' THEN CASE WHEN was = 'PLANNED' THEN 'planned' WHEN new_evidence = 0 THEN 'no_new_evidence' WHEN new_confidence < held THEN 'confidence_lowered' END
  WHEN operation = 'supersede' AND was = 'PLANNED' THEN 'planned'
  WHEN operation = 'contradict' AND other_was IN ('SUPERSEDED', 'RETRACTED') THEN 'other_terminal'
  WHEN operation = 'close' AND was = 'ENDED' THEN 'already_closed' WHEN operation = 'close' AND was NOT IN ('ACTIVE', 'CONTRADICTED') THEN 'not_active' END AS reason FROM cmd)
SELECT operation, reason, NULL AS assertion_id, NULL::BIGINT AS revision, NULL AS status, NULL AS epistemic, NULL::DOUBLE AS confidence, NULL::BOOLEAN AS closed, NULL AS successor FROM r WHERE reason IS NOT NULL
UNION ALL SELECT operation, NULL, assertion_id, CASE operation WHEN 'assert' THEN 1 ELSE revision + 1 END,
  CASE operation WHEN 'assert' THEN new_status WHEN 'confirm' THEN was WHEN 'supersede' THEN 'SUPERSEDED' WHEN 'contradict' THEN 'CONTRADICTED' WHEN 'retract' THEN 'RETRACTED' ELSE 'ENDED' END,
  CASE operation WHEN 'contradict' THEN 'CONFLICTED' END, CASE WHEN operation IN ('assert', 'confirm') THEN new_confidence ELSE held END, operation IN ('supersede', 'close'), CASE operation WHEN 'supersede' THEN successor_id END FROM r WHERE reason IS NULL
UNION ALL SELECT operation, NULL, successor_id, 1, 'ACTIVE', NULL, new_confidence, false, NULL FROM r WHERE reason IS NULL AND operation = 'supersede'
UNION ALL SELECT operation, NULL, other_id, other_revision + 1, 'CONTRADICTED', 'CONFLICTED', other_held, false, NULL FROM r WHERE reason IS NULL AND operation = 'contradict'""")
def ledger_moves(spark, sf):
    return moves.moved(commands(spark, sf))


@query("ledger_expected_state", f"""WITH {LEDGER}, a AS (SELECT assertion_id, count(*) AS revision, arg_max(status, (recorded_at, seq)) AS status FROM ledger WHERE recorded_at <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY assertion_id),
b AS (SELECT assertion_id, count(*) AS revision, arg_max(status, (recorded_at, seq)) AS status FROM ledger WHERE recorded_at <= TIMESTAMP '2024-01-12 00:00:00' GROUP BY assertion_id)
SELECT b.assertion_id, CASE WHEN a.revision = b.revision THEN 'as_expected' WHEN a.revision IS NULL THEN 'exists' ELSE 'revision_changed' END AS finding FROM b LEFT JOIN a ON a.assertion_id = b.assertion_id""")
def ledger_expected_state(spark, sf):
    """What plans made on the 10th would find on the 12th."""
    at = lambda day: entries(spark, sf).filter(F.col("recorded_at") <= instant(day)).groupBy("assertion_id").agg(F.count("*").alias("revision"), F.max_by("status", F.struct("recorded_at", "seq")).alias("status"))
    now, then = at(12), at(10)
    expected = now.select("assertion_id").join(then.select("assertion_id", F.col("revision").alias("want_revision"), F.col("status").alias("want_status")), "assertion_id", "left")
    return moves.state_changed(expected, now)


@query("ledger_sealed_heads", f"""WITH {LEDGER}, b AS (SELECT assertion_id, list(seq || '|' || assertion_id || '|' || status || '|' || format('{{:.6f}}', confidence) ORDER BY recorded_at, seq) AS bodies FROM ledger GROUP BY assertion_id)
SELECT assertion_id, len(bodies) AS entries, list_reduce(list_prepend('genesis', bodies), lambda a, x: sha256(a || '|' || x)) AS head FROM b""")
def ledger_sealed_heads(spark, sf):
    rows = entries(spark, sf)
    last = rows.join(moves.sealed(rows), ["seq", "assertion_id"]).groupBy("assertion_id").agg(F.count("*").alias("entries"), F.max_by("entry_hash", F.struct("recorded_at", "seq")).alias("head"))
    return last.select("assertion_id", "entries", "head")


@query("ledger_tampered", f"WITH {LEDGER} SELECT seq, assertion_id, 'altered' AS fault FROM ledger WHERE status = 'RETRACTED'")
def ledger_tampered(spark, sf):
    """Retracted entries rewritten to active ones after sealing: each is found, and none beside them."""
    rows = entries(spark, sf)
    stored = rows.join(moves.sealed(rows), ["seq", "assertion_id"]).withColumn("status", F.when(F.col("status") == "RETRACTED", "ACTIVE").otherwise(F.col("status")))
    return moves.broken(stored)


@query("ledger_snapshot", f"""WITH {LEDGER}, l AS (SELECT assertion_id, subject, predicate, count(*) AS revision, arg_max(status, (recorded_at, seq)) AS status FROM ledger GROUP BY ALL)
SELECT subject, CAST(sum(revision) AS BIGINT) AS version, sha256(string_agg(predicate || '|' || assertion_id || '|' || status, chr(10) ORDER BY predicate || '|' || assertion_id || '|' || status)) AS hash FROM l GROUP BY subject""")
def ledger_snapshot(spark, sf):
    rows = entries(spark, sf).groupBy("assertion_id", "subject", "predicate").agg(F.count("*").alias("revision"), F.max_by("status", F.struct("recorded_at", "seq")).alias("status"))
    return moves.snapshot(rows)


@query("ledger_edges", """WITH a AS (SELECT l_suppkey AS subject, l_partkey AS object, l_returnflag AS predicate, l_discount AS confidence, l_tax > 0.07 AS negated,
  CASE WHEN l_linenumber = 7 THEN 'RETRACTED' WHEN l_linenumber = 6 THEN 'PLANNED' WHEN l_linenumber = 5 THEN 'CONTRADICTED' ELSE 'ACTIVE' END AS status FROM lineitem)
SELECT subject AS src, object AS dst, predicate, confidence FROM a WHERE status = 'ACTIVE' AND NOT negated""")
def ledger_edges(spark, sf):
    n = F.col("l_linenumber")
    status = first_that((n == 7, "RETRACTED"), (n == 6, "PLANNED"), (n == 5, "CONTRADICTED"), otherwise="ACTIVE")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object"), F.col("l_returnflag").alias("predicate"), F.col("l_discount").alias("confidence"), (F.col("l_tax") > 0.07).alias("negated"), status.alias("status"))
    return moves.projected(rows)


@query("ledger_chains", """WITH RECURSIVE l AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS successor, row_number() OVER w AS rk, count(*) OVER (PARTITION BY o_custkey) AS n,
  last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT id, last, CAST(n - rk AS BIGINT) AS steps, false AS cycle FROM l WHERE successor IS NOT NULL""")
def ledger_chains(spark, sf):
    """Each order is superseded by the customer's next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("successor"))
    return moves.chain_ends(links, lambda x: staged(x, "chain"))
