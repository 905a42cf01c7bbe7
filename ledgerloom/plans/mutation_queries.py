"""Queries on mutation plans, admission, rollback, mentions, antecedents, aliases and structural rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.scores import first_that
from ledgerloom.operators import admission, mutation
from ledgerloom.session import dealt
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- plans: an order is a plan, its lines are decisions

def decisions(spark, sf):
    claim = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), claim.alias("claim_id"), (F.col("l_suppkey") % 4).alias("a"), F.concat(F.lit("P"), F.col("l_linenumber") % 2).alias("predicate"), (F.col("l_partkey") % 4).alias("b"),
        F.when(F.col("l_quantity") > 10, "ACCEPT").otherwise("REVIEW").alias("action"), F.when(F.col("l_linestatus") == "F", claim - 1).alias("supersedes"), (F.col("l_returnflag") == "R").alias("negated"),
    )


def accepted(spark, sf):
    """Accepted decisions, each plan whole in a partition."""
    return dealt(decisions(spark, sf).filter("action = 'ACCEPT'"), table(spark, sf, "lineitem").count(), "plan_id")


# Written from the rules: create, supersede, project; assertions of a pair and predicate may not be repeated nor turned round.
OPS = """d AS (SELECT l_orderkey AS plan_id, l_orderkey * 10 + l_linenumber AS claim_id, l_suppkey % 4 AS a, 'P' || l_linenumber % 2 AS predicate, l_partkey % 4 AS b, (l_suppkey % 4) || '|P' || (l_linenumber % 2) || '|' || (l_partkey % 4) AS canonical_key, l_linestatus, l_returnflag FROM lineitem WHERE l_quantity > 10),
o AS (SELECT *, sha256(concat_ws('|', plan_id, claim_id, place, op, canonical_key)) AS op_key FROM (SELECT *, 0 AS place, 'CREATE_ASSERTION' AS op FROM d UNION ALL SELECT *, 1, 'SUPERSEDE_ASSERTION' FROM d WHERE l_linestatus = 'F' UNION ALL SELECT *, 2, 'PROJECT_RELATION' FROM d WHERE l_returnflag <> 'R'))"""
BAD = """k AS (SELECT DISTINCT plan_id, TRUE AS twice FROM (SELECT plan_id FROM d GROUP BY plan_id, canonical_key HAVING count(*) > 1)),
x AS (SELECT DISTINCT p.plan_id, TRUE AS opposed FROM d p JOIN d q ON p.plan_id = q.plan_id AND p.predicate = q.predicate AND p.a = q.b AND p.b = q.a AND p.a < p.b),
bad AS (SELECT plan_id, coalesce(twice, FALSE) AS twice, coalesce(opposed, FALSE) AS opposed FROM k FULL JOIN x USING (plan_id))"""


@query("plan_operations", f"WITH {OPS} SELECT plan_id, place, op, claim_id, canonical_key, op_key FROM o")
def plan_operations(spark, sf):
    return mutation.planned(decisions(spark, sf)).select("plan_id", "place", "op", "claim_id", "canonical_key", "op_key")


@query("plan_consistency", f"WITH {OPS}, {BAD} SELECT plan_id, twice, opposed FROM bad")
def plan_consistency(spark, sf):
    return mutation.inconsistent(mutation.planned(accepted(spark, sf)))


@query("plan_simulation", f"""WITH {OPS}, {BAD}, done AS (SELECT o.* FROM o JOIN orders ON o_orderkey = plan_id WHERE o_orderstatus = 'F'), late AS (SELECT o.* FROM o UNION ALL SELECT o.* FROM o WHERE op = 'CREATE_ASSERTION'),
r AS (SELECT plan_id, op, CASE WHEN plan_id IN (SELECT plan_id FROM bad) THEN 'refused' WHEN op_key IN (SELECT op_key FROM done) THEN 'skipped' WHEN row_number() OVER (PARTITION BY op_key) > 1 THEN 'repeated' ELSE 'would_apply' END AS outcome FROM late)
SELECT op, outcome, count(*) AS n FROM r GROUP BY ALL""")
def plan_simulation(spark, sf):
    """Creations are sent twice; plans of filled orders were applied before."""
    ops = mutation.planned(accepted(spark, sf))
    filled = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("plan_id"))
    sent = ops.withColumn("time", F.explode(F.sequence(F.lit(1), F.when(F.col("op") == "CREATE_ASSERTION", 2).otherwise(1)))).drop("time")
    return mutation.simulated(sent, ops.join(filled, "plan_id", "left_semi"), mutation.inconsistent(ops)).groupBy("op", "outcome").agg(F.count("*").alias("n"))


@query("plan_rollback", f"""WITH {OPS}, w AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY claim_id, canonical_key, place, op_key) AS written FROM (SELECT DISTINCT plan_id, claim_id, canonical_key, place, op, op_key FROM o))
SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY written DESC) AS step, CASE op WHEN 'CREATE_ASSERTION' THEN 'DELETE_NODE' WHEN 'SUPERSEDE_ASSERTION' THEN 'RESTORE_PROPERTIES' ELSE 'DELETE_RELATIONSHIP' END AS action,
  CASE op WHEN 'PROJECT_RELATION' THEN 'edge-' || claim_id WHEN 'CREATE_ASSERTION' THEN 'new-' || claim_id ELSE 'old-' || (claim_id - 1) END AS target, CASE WHEN op = 'SUPERSEDE_ASSERTION' THEN 'status=ACTIVE' ELSE '' END AS restore,
  CASE WHEN op = 'SUPERSEDE_ASSERTION' THEN 'reason_code,superseded_by,valid_to' ELSE '' END AS lost FROM w""")
def plan_rollback(spark, sf):
    """Before a supersession only the status was read, so its other properties are lost."""
    # A claim that is decided twice with the same key has its operations once.
    no = F.bool_and(F.coalesce("negated", F.lit(False))).alias("negated")
    claims = accepted(spark, sf).groupBy("plan_id", "claim_id", "a", "predicate", "b").agg(F.max("supersedes").alias("supersedes"), no).withColumn("action", F.lit("ACCEPT"))
    ops = mutation.last_first(mutation.planned(claims).select("plan_id", "claim_id", "canonical_key", "place", "op"), "claim_id", "canonical_key", "place")
    supersedes = F.col("op") == "SUPERSEDE_ASSERTION"
    kinds = first_that(*[(F.col("op") == op, kind) for op, kind in mutation.WRITES.items()], otherwise=None)
    target = F.when(supersedes, F.concat(F.lit("old-"), F.col("claim_id") - 1)).otherwise(F.concat(F.lit("new-"), "claim_id"))
    applied = ops.select(
        "plan_id", "step", kinds.alias("kind"), F.concat(F.lit("edge-"), "claim_id").alias("created"), target.alias("target"),
        F.when(supersedes, F.array(*map(F.lit, mutation.SUPERSEDED))).alias("changed"), F.when(supersedes, F.create_map(F.lit("status"), F.lit("ACTIVE"))).alias("previous"),
    )
    restore = F.array_join(F.transform(F.map_entries(F.coalesce("restore", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return mutation.undone(applied).select("plan_id", F.col("step").cast("long"), "action", "target", restore.alias("restore"), F.array_join("lost", ",").alias("lost"))


@query("plan_admission", """WITH c AS (SELECT o_orderkey AS plan_id, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS approved, o_orderstatus <> 'F' AS fresh, CASE WHEN o_totalprice > 100000 THEN o_custkey % 3 > 0 END AS signed, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS scoped FROM orders)
SELECT plan_id, array_to_string(list_filter([CASE WHEN NOT approved THEN 'NOT_APPROVED' END, CASE WHEN NOT coalesce(signed, FALSE) THEN 'NOT_SIGNED' END, CASE WHEN NOT scoped THEN 'OTHER_SCOPE' END, CASE WHEN NOT fresh THEN 'SNAPSHOT_OLD' END], lambda x: x IS NOT NULL), ',') AS refusals FROM c""")
def plan_admission(spark, sf):
    scoped = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("scoped")).distinct()
    plans = table(spark, sf, "orders").join(scoped, "o_custkey", "left")
    why = mutation.refused(
        NOT_APPROVED=F.substring("o_orderpriority", 1, 1).isin("1", "2"), SNAPSHOT_OLD=F.col("o_orderstatus") != "F", NOT_SIGNED=F.when(F.col("o_totalprice") > 100000, F.col("o_custkey") % 3 > 0), OTHER_SCOPE=F.col("scoped")
    )
    return plans.select(F.col("o_orderkey").alias("plan_id"), F.array_join(why, ",").alias("refusals"))


@query("relation_endpoints", """WITH n AS (SELECT p_partkey AS node_id, CASE WHEN p_size > 10 THEN p_size % 3 END AS scope FROM part), r AS (SELECT l_orderkey * 10 + l_linenumber AS rel_id, l_partkey AS a, l_suppkey + 195 AS b, l_linenumber % 3 AS scope FROM lineitem),
e AS (SELECT rel_id, CASE WHEN x.node_id IS NULL THEN 2 WHEN x.scope IS NULL OR x.scope = r.scope THEN 0 ELSE 1 END AS p, CASE WHEN y.node_id IS NULL THEN 2 WHEN y.scope IS NULL OR y.scope = r.scope THEN 0 ELSE 1 END AS q FROM r LEFT JOIN n x ON x.node_id = r.a LEFT JOIN n y ON y.node_id = r.b)
SELECT rel_id, CASE greatest(p, q) WHEN 0 THEN 'ok' WHEN 1 THEN 'other_scope' ELSE 'missing' END AS ends FROM e""")
def relation_endpoints(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_size") > 10, F.col("p_size") % 3).alias("scope"))
    relations = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rel_id"), F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 195).alias("b"), (F.col("l_linenumber") % 3).alias("scope"))
    return mutation.endpoints(relations, nodes)


# ---- mentions

@query("kept_mentions", """WITH RECURSIVE h AS (SELECT l_suppkey AS text_id, l_orderkey * 6 + l_linenumber AS start, l_orderkey * 6 + l_linenumber + 1 + l_partkey % 9 AS stop, l_discount AS confidence, l_returnflag || l_orderkey || '-' || l_linenumber AS surface FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY start, stop DESC, confidence DESC, surface) AS rn FROM h),
w AS (SELECT text_id, rn, start, stop, surface, TRUE AS kept, stop AS until FROM n WHERE rn = 1 UNION ALL SELECT n.text_id, n.rn, n.start, n.stop, n.surface, n.start >= w.until, CASE WHEN n.start >= w.until THEN n.stop ELSE w.until END FROM w JOIN n ON n.text_id = w.text_id AND n.rn = w.rn + 1)
SELECT text_id, start, stop, surface FROM w WHERE kept""")
def kept_mentions(spark, sf):
    start = F.col("l_orderkey") * 6 + F.col("l_linenumber")
    hits = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("text_id"), start.alias("start"), (start + 1 + F.col("l_partkey") % 9).alias("end"), F.col("l_discount").alias("confidence"), F.concat("l_returnflag", "l_orderkey", F.lit("-"), "l_linenumber").alias("surface"))
    return mutation.deduped_mentions(hits).select("text_id", "start", F.col("end").alias("stop"), "surface")


@query("antecedents", """WITH t AS (SELECT user_id AS text_id, event_id AS place, CASE WHEN event_type IN ('click', 'error') THEN 'pronoun' ELSE 'mention' END AS kind, CAST(floor(value) AS BIGINT) % 4 AS entity FROM events),
m AS (SELECT p.text_id, p.place, min(q.entity) AS lo, max(q.entity) AS hi FROM t p LEFT JOIN t q ON q.text_id = p.text_id AND q.kind = 'mention' AND q.place BETWEEN p.place - 150 AND p.place - 1 WHERE p.kind = 'pronoun' GROUP BY ALL)
SELECT text_id, place, CASE WHEN lo IS NULL THEN 'no_antecedent' WHEN lo <> hi THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN lo = hi THEN lo END AS entity FROM m""")
def antecedents(spark, sf):
    kind = F.when(F.col("event_type").isin("click", "error"), "pronoun").otherwise("mention")
    tokens = table(spark, sf, "events").select(F.col("user_id").alias("text_id"), F.col("event_id").alias("place"), kind.alias("kind"), (F.floor("value").cast("long") % 4).alias("entity"))
    return mutation.antecedents(tokens, 150)


@query("error_forms", """WITH t AS (SELECT p_name AS canonical, p_size / 50.0::DOUBLE AS confidence, unnest([string_split(p_name, ' ')[1], ' ' || upper(p_type), upper(p_name), '']) AS f FROM part), f AS (SELECT canonical, confidence, lower(trim(f)) AS form FROM t)
SELECT form, arg_min(canonical, (-confidence, canonical)) AS canonical, max(confidence) AS confidence FROM f WHERE form <> '' AND form <> lower(canonical) GROUP BY form""")
def error_forms(spark, sf):
    forms = F.array(F.split("p_name", " ")[0], F.concat(F.lit(" "), F.upper("p_type")), F.upper("p_name"), F.lit(""))
    return mutation.error_forms(table(spark, sf, "part").select(F.col("p_name").alias("canonical"), (F.col("p_size") / 50.0).alias("confidence"), forms.alias("forms")))


@query("alias_map", """WITH e AS (SELECT c_custkey AS entity, c_name || ' ' || c_mktsegment || ' of' AS name FROM customer),
w AS (SELECT DISTINCT entity, unnest(string_split(lower(name), ' ')) AS alias FROM e), u AS (SELECT alias, min(entity) AS entity FROM w WHERE length(alias) >= 3 GROUP BY alias HAVING count(*) = 1),
a AS (SELECT lower(name) AS alias, entity, 1 AS rank FROM e UNION ALL SELECT alias, entity, 2 FROM u UNION ALL SELECT lower(s_name), s_suppkey, 3 FROM supplier UNION ALL SELECT lower(c_name), c_custkey + 1, 3 FROM customer)
SELECT alias, arg_min(entity, (rank, entity)) AS entity FROM a WHERE alias <> '' GROUP BY alias""")
def alias_map(spark, sf):
    customers = table(spark, sf, "customer")
    entities = customers.select(F.col("c_custkey").alias("entity"), F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" of")).alias("name"))
    glossary = table(spark, sf, "supplier").select(F.col("s_name").alias("alias"), F.col("s_suppkey").alias("entity")).union(customers.select("c_name", F.col("c_custkey") + 1))
    return mutation.alias_map(entities, glossary)


# ---- small rules

SCOPE = "CASE p_size % 5 WHEN 0 THEN 'from=1|state= ended' WHEN 1 THEN 'state=ACTIVE|to=3' WHEN 2 THEN 'state=odd' WHEN 3 THEN 'substate=PAST' END"
PATH = "CASE p_size % 7 WHEN 0 THEN '../' || p_brand WHEN 1 THEN '/' || p_brand WHEN 2 THEN 'C:' || p_brand WHEN 3 THEN '' WHEN 4 THEN 'a/..b/' || p_brand WHEN 5 THEN 'a/../' || p_brand END"


@query("scope_states", f"SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'ENDED' WHEN 1 THEN 'ACTIVE' ELSE 'UNKNOWN' END AS state, coalesce(p_size % 7 = 4, FALSE) AS safe FROM part")
def scope_states(spark, sf):
    return table(spark, sf, "part").select("p_partkey", mutation.state_of(F.expr(SCOPE)).alias("state"), mutation.safe_path(F.expr(PATH)).alias("safe"))


@query("structural_rates", """WITH r AS (SELECT l_quantity > 20 AS predicate_ok, l_tax < 0.05 AS direction_ok, l_returnflag, l_linestatus FROM lineitem), p AS (SELECT 'all' AS part, * FROM r UNION ALL SELECT 'negated', * FROM r WHERE l_returnflag = 'R' UNION ALL SELECT 'simple', * FROM r WHERE l_linestatus = 'O' UNION ALL SELECT 'rumoured', * FROM r WHERE l_linestatus = 'X'),
n(part) AS (VALUES ('all'), ('negated'), ('simple'), ('rumoured'))
SELECT part, count(predicate_ok) AS n, coalesce(round(count(*) FILTER (predicate_ok) / nullif(count(predicate_ok), 0)::DOUBLE, 4), 0.0)::DOUBLE AS predicate_ok, coalesce(round(count(*) FILTER (direction_ok) / nullif(count(predicate_ok), 0)::DOUBLE, 4), 0.0)::DOUBLE AS direction_ok FROM n LEFT JOIN p USING (part) GROUP BY part""")
def structural_rates(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") > 20).alias("predicate_ok"), (F.col("l_tax") < 0.05).alias("direction_ok"), "l_returnflag", "l_linestatus")
    groups = {"negated": F.col("l_returnflag") == "R", "simple": F.col("l_linestatus") == "O", "rumoured": F.col("l_linestatus") == "X"}
    return mutation.subgroup_rates(rows, ["predicate_ok", "direction_ok"], groups)


# ---- admission in full: an order is a plan, its lines are operations; each fault has its remainder

@query("plan_refusals", """WITH n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity = 50) AS underived, count(*) FILTER (l_returnflag = 'A' AND l_tax > 0.07) AS overrides FROM lineitem GROUP BY ALL),
p AS (SELECT o_orderkey AS k, o_orderkey % 13 AS r, o_custkey % 7 AS s, coalesce(n, 0) AS n, coalesce(underived, 0) AS underived, coalesce(overrides, 0) AS overrides FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
SELECT k AS plan_id, array_to_string(list_sort(list_filter([CASE WHEN r IN (1, 2) THEN 'PLAN_CONTRACT_VERSION_UNSUPPORTED' END, CASE WHEN r IN (3, 4) THEN 'PLAN_NOT_APPROVED' END, CASE WHEN r = 5 THEN 'PLAN_NOT_SIGNED_LOCALLY' END, CASE WHEN r IN (6, 7) THEN 'PLAN_VALIDATOR_CHAIN_NOT_PASS' END,
  CASE WHEN r = 8 OR n = 0 THEN 'PLAN_SIGNATURE_MISMATCH' END, CASE WHEN underived > 0 THEN 'PLAN_IDEMPOTENCY_KEY_UNDERIVED' END, CASE WHEN r = 9 THEN 'PLAN_EXPIRY_UNREADABLE' END, CASE WHEN r = 10 THEN 'PLAN_EXPIRED' END, CASE WHEN r = 11 THEN 'PLAN_WORKSPACE_MISMATCH' END,
  CASE WHEN s IN (3, 4, 5, 6) OR (s = 2 AND r = 11) THEN 'PLAN_SCOPE_CROSS_PARTIDA' END, CASE WHEN s IN (0, 2, 6) AND overrides > 0 THEN 'PLAN_LOCAL_OVERRIDE_FROM_GAME_LAYER' END, CASE WHEN r = 12 THEN 'PLAN_SNAPSHOT_STALE' END, CASE WHEN n = 0 THEN 'PLAN_NO_OPERATIONS' END], lambda x: x IS NOT NULL)), ',') AS refusals FROM p""")
def plan_refusals(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("operation_id"), F.lit("CREATE_ASSERTION").alias("op"), F.col("l_partkey").cast("string").alias("assertion_id"), F.lit("{}").alias("payload"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_tax") > 0.07), "").alias("local_override_of"), (F.col("l_quantity") == 50).alias("spoilt"),
    )
    ops = lines.withColumn("op_key", F.when(F.col("spoilt"), "x").otherwise(admission.digest("plan_id", "operation_id", "op", "assertion_id", "payload"))).drop("spoilt")
    r, s = F.col("o_orderkey") % 13, F.col("o_custkey") % 7
    hashes = admission.operations_summary(ops).select(F.col("plan_id").alias("o_orderkey"), "ops_hash")
    scope = lambda layer, part, game: F.struct(F.lit(layer).alias("layer"), F.lit(part).cast("string").alias("partida_id"), F.lit(game).cast("string").alias("game_id"))
    # The scopes: none; a part named by both; a game; a part that the plan does not name; other parts; no layer; a plan's part alone.
    scopes = first_that((s == 1, scope("PARTIDA", "p1", None)), (s == 2, scope("GAME", None, "w")), (s == 3, scope("PARTIDA", "p1", None)), (s == 4, scope("PARTIDA", "p2", None)), (s == 5, scope("OTHER", "p1", None)), (s == 6, scope("GAME", None, "other")), otherwise=None)
    plans = table(spark, sf, "orders").join(hashes, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("plan_id"), first_that((r == 1, "3.1"), (r == 2, "x"), otherwise="2.0").alias("version"), first_that((r == 3, F.lit(False)), (r == 4, F.lit(None).cast("boolean")), otherwise=F.lit(True)).alias("approved"),
        F.when(r == 5, "EXTERNAL").otherwise("LOCAL").alias("approver"), first_that((r == 6, F.array().cast("array<string>")), (r == 7, F.array(F.lit("PASS"), F.lit("FAIL"))), otherwise=F.array(F.lit("PASS"))).alias("validators"),
        F.when(r == 8, "tampered").otherwise(F.col("ops_hash")).alias("plan_hash"), first_that((r == 9, "soon"), (r == 10, "2024-01-01T00:00:00Z"), otherwise="2030-01-01T00:00:00Z").alias("expires_at"), F.when(r == 11, "v").otherwise("w").alias("workspace"),
        first_that((s == 1, "p1"), (s == 4, "p1"), (s == 5, "p1"), otherwise=None).alias("partida_id"), scopes.alias("scope"), F.when(r == 12, "old").otherwise("now").alias("snapshot_id"),
    )
    return admission.admitted(plans, ops, "w", "now", "2026-01-01T00:00:00Z").select("plan_id", F.array_join("refusals", ",").alias("refusals"))


@query("operator_gate", """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT o_orderkey AS k, o_orderkey % 14 AS r, o_custkey % 9 AS s, n FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
SELECT k AS request_id, array_to_string(list_sort(list_filter([CASE WHEN r IN (0, 1) THEN 'GATE_ENV_NOT_ALLOWED' END, CASE WHEN r = 2 THEN 'GATE_APPLY_NOT_REQUESTED' END, CASE WHEN r IN (3, 4) THEN 'GATE_OPERATOR_MISSING' END, CASE WHEN r = 5 THEN 'GATE_OPERATOR_INVALID' END,
  CASE WHEN n IS NULL OR r IN (6, 7) THEN 'GATE_PLAN_HASH_NOT_CONFIRMED' END, CASE WHEN s = 0 OR coalesce(n, 0) > s THEN 'GATE_OPERATION_LIMIT_EXCEEDED' END, CASE WHEN r = 8 THEN 'GATE_WORKSPACE_NOT_DECLARED' END, CASE WHEN r IN (9, 10) THEN 'GATE_WORKSPACE_DECLARATION_MISMATCH' END,
  CASE WHEN r IN (11, 12) THEN 'GATE_AUDIT_UNAVAILABLE' END], lambda x: x IS NOT NULL)), ',') AS refusals FROM p""")
def operator_gate(spark, sf):
    r, s = F.col("o_orderkey") % 14, F.col("o_custkey") % 9
    plans = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id")).agg(F.count("*").alias("n_ops")).withColumn("plan_hash", F.sha2(F.col("plan_id").cast("string"), 256))
    confirmed = first_that((r == 6, ""), (r == 7, "0" * 64), otherwise=F.concat(F.lit(" "), F.upper(F.sha2(F.col("o_orderkey").cast("string"), 256))))
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("plan_id"), first_that((r == 0, "0"), (r == 1, None), otherwise="1").alias("allowed"), (r != 2).alias("apply"), first_that((r == 3, ""), (r == 4, None), (r == 5, "-me"), otherwise="op:1").alias("operator_id"),
        confirmed.alias("confirmed_hash"), s.alias("max_operations"), F.when(r == 8, "").otherwise("w").alias("env_workspace"), first_that((r == 9, "v"), (r == 10, None), otherwise="w").alias("workspace"), first_that((r == 11, F.lit(False)), (r == 12, F.lit(None).cast("boolean")), otherwise=F.lit(True)).alias("audited"),
    )
    return admission.gate(requests, plans).select("request_id", F.array_join("refusals", ",").alias("refusals"))
