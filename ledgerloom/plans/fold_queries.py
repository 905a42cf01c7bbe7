"""Queries whose decisions depend on the order of what came before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import folds
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("budget_admissions", """WITH RECURSIVE r AS (SELECT o_custkey % 60 AS run, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS cost, o_orderpriority LIKE '5%' AS refund, row_number() OVER (PARTITION BY o_custkey % 60 ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
s AS (SELECT run, id, rn, refund OR cost <= 2000000 AS ok, CASE WHEN refund OR cost > 2000000 THEN 0 ELSE 1 END::BIGINT AS calls, CASE WHEN refund OR cost > 2000000 THEN 0 ELSE cost END AS used FROM r WHERE rn = 1
  UNION ALL SELECT r.run, r.id, r.rn, r.refund OR (calls < 30 AND used + r.cost <= 2000000), CASE WHEN r.refund THEN greatest(0, calls - 1) WHEN calls < 30 AND used + r.cost <= 2000000 THEN calls + 1 ELSE calls END, CASE WHEN r.refund THEN greatest(0, used - r.cost) WHEN calls < 30 AND used + r.cost <= 2000000 THEN used + r.cost ELSE used END
  FROM s JOIN r ON r.run = s.run AND r.rn = s.rn + 1)
SELECT run::VARCHAR AS run, id AS request_id, ok AS admitted, calls, used AS cost FROM s""")
def budget_admissions(spark, sf):
    """Orders of sixty runs, thirty calls and two million units each; the least urgent are refunds."""
    orders = table(spark, sf, "orders")
    requests = orders.select((F.col("o_custkey") % 60).alias("run"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("request_id"), F.floor("o_totalprice").alias("cost"), F.when(F.col("o_orderpriority").startswith("5"), "refund").otherwise("call").alias("kind"))
    return folds.admitted(requests, 30, 2_000_000)


EVENTS = """e AS (SELECT l_orderkey AS moment, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT || '-' || l_shipdate::DATE AS event_id, 'w' || l_suppkey % 5 AS workspace, CASE WHEN l_linestatus = 'F' THEN 's' || l_suppkey % 2 END AS scope, 'n' || l_partkey % 30 AS surface,
  'e' || l_partkey % 7 AS entity, 'r' || l_orderkey % 11 AS res, l_discount AS sure, CASE l_quantity::INT WHEN 50 THEN 'forget_entity' WHEN 49 THEN 'forget_surface' WHEN 48 THEN 'forget_resolution' ELSE CASE WHEN l_quantity::INT = 47 AND l_tax > 0.07 THEN 'forget_workspace' ELSE 'record' END END AS kind FROM lineitem),
keys AS (SELECT DISTINCT workspace, scope, surface FROM e WHERE kind = 'record'),
seen AS (SELECT k.workspace, k.scope, k.surface, e.moment, e.event_id, e.kind, e.entity, e.res, e.sure FROM keys k JOIN e ON e.workspace = k.workspace AND (e.kind NOT IN ('record', 'forget_surface') OR e.surface = k.surface AND e.scope IS NOT DISTINCT FROM k.scope)),
n AS (SELECT *, row_number() OVER (PARTITION BY workspace, scope, surface ORDER BY moment, event_id) AS rn FROM seen),
m AS (SELECT workspace, scope, surface, rn, CASE WHEN kind = 'record' THEN entity END AS h, CASE WHEN kind = 'record' THEN sure END AS c, CASE WHEN kind = 'record' THEN res END AS r FROM n WHERE rn = 1
  UNION ALL SELECT workspace, scope, surface, rn, CASE WHEN take THEN entity WHEN NOT lose THEN h END, CASE WHEN take THEN sure WHEN NOT lose THEN c END, CASE WHEN take THEN res WHEN NOT lose THEN r END
  FROM (SELECT n.*, m.h, m.c, m.r, n.kind = 'record' AND (m.h IS NULL OR (n.entity <> m.h AND n.sure > m.c)) AS take, n.kind <> 'record' AND (n.kind IN ('forget_surface', 'forget_workspace') OR (n.kind = 'forget_entity' AND n.entity = m.h) OR (n.kind = 'forget_resolution' AND n.res = m.r)) AS lose
    FROM m JOIN n ON n.workspace = m.workspace AND n.scope IS NOT DISTINCT FROM m.scope AND n.surface = m.surface AND n.rn = m.rn + 1)),
held AS (SELECT m.* FROM m JOIN (SELECT workspace, scope, surface, max(rn) AS rn FROM n GROUP BY ALL) z ON z.workspace = m.workspace AND z.scope IS NOT DISTINCT FROM m.scope AND z.surface = m.surface AND z.rn = m.rn WHERE h IS NOT NULL)"""


def memory_events(spark, sf):
    q = F.col("l_quantity").cast("int")
    kind = F.when(q == 50, "forget_entity").when(q == 49, "forget_surface").when(q == 48, "forget_resolution").when((q == 47) & (F.col("l_tax") > 0.07), "forget_workspace").otherwise("record")
    named = lambda p, c: F.concat(F.lit(p), c)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("at"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q, F.col("l_shipdate").cast("date")).alias("event_id"), kind.alias("kind"), named("w", F.col("l_suppkey") % 5).alias("workspace"),
        F.when(F.col("l_linestatus") == "F", named("s", F.col("l_suppkey") % 2)).alias("scope"), named("n", F.col("l_partkey") % 30).alias("surface"), named("e", F.col("l_partkey") % 7).alias("entity_id"), named("r", F.col("l_orderkey") % 11).alias("resolution_id"),
        F.col("l_discount").alias("confidence"), F.lit("LINK_EXISTING").alias("action"),
    )


@query("session_memory", f"WITH RECURSIVE {EVENTS} SELECT workspace, scope, surface, h AS entity_id, c AS confidence, r AS resolution_id FROM held")
def session_memory(spark, sf):
    return folds.memory(memory_events(spark, sf))


@query("session_recall", f"""WITH RECURSIVE {EVENTS}, q AS (SELECT o_orderkey AS mention_id, 'w' || o_custkey % 6 AS workspace, CASE WHEN o_orderstatus = 'F' THEN 's' || o_custkey % 3 END AS scope, 'n' || o_orderkey % 35 AS surface FROM orders)
SELECT mention_id, coalesce(o.h, s.h) AS entity_id, CASE WHEN o.h IS NOT NULL THEN 'own' WHEN s.h IS NOT NULL THEN 'shared' ELSE 'none' END AS source
FROM q LEFT JOIN held o ON o.workspace = q.workspace AND o.scope = q.scope AND o.surface = q.surface LEFT JOIN held s ON s.scope IS NULL AND s.workspace = q.workspace AND s.surface = q.surface""")
def session_recall(spark, sf):
    named = lambda p, c: F.concat(F.lit(p), c)
    mentions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mention_id"), named("w", F.col("o_custkey") % 6).alias("workspace"), F.when(F.col("o_orderstatus") == "F", named("s", F.col("o_custkey") % 3)).alias("scope"), named("n", F.col("o_orderkey") % 35).alias("surface"))
    return folds.recalled(mentions, folds.memory(memory_events(spark, sf)))
