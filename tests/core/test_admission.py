"""Admission of plans: one fault at a time, nulls as faults, and scopes that contradict themselves."""

from pyspark.sql import functions as F

from ledgerloom.operators import admission

PLAN = "plan_id int, version string, approved boolean, approver string, validators array<string>, expires_at string, workspace string, partida_id string, scope struct<layer:string,partida_id:string,game_id:string>, snapshot_id string"
GOOD = ("2.3", True, "LOCAL", ["PASS"], "2030-01-01T00:00:00Z", "w", None, None, "s")


def test_faults(spark):
    rows, want = [], {}

    def add(change, *expected):
        k = len(rows)
        row = list(GOOD)
        for at, v in change.items():
            row[at] = v
        rows.append((k, *row))
        want[k] = sorted(expected)

    add({})
    add({0: "1.0"}, "PLAN_CONTRACT_VERSION_UNSUPPORTED")
    add({0: None, 1: None, 2: None, 3: None, 4: None, 5: None, 8: None}, "PLAN_CONTRACT_VERSION_UNSUPPORTED", "PLAN_NOT_APPROVED", "PLAN_NOT_SIGNED_LOCALLY", "PLAN_VALIDATOR_CHAIN_NOT_PASS", "PLAN_EXPIRY_UNREADABLE", "PLAN_WORKSPACE_MISMATCH", "PLAN_SNAPSHOT_STALE")
    add({3: []}, "PLAN_VALIDATOR_CHAIN_NOT_PASS")
    add({3: ["PASS", None]}, "PLAN_VALIDATOR_CHAIN_NOT_PASS")
    add({4: "2026-01-01T00:00:00Z"}, "PLAN_EXPIRED")
    for partida, scope in (("p", None), (None, ("PARTIDA", "p", None)), ("p", ("PARTIDA", "", None)), ("p", ("GAME", "p", None)), ("p", ("PARTIDA", "q", None)), ("p", (None, "p", None)), (None, ("GAME", None, "v"))):
        add({6: partida, 7: scope}, "PLAN_SCOPE_CROSS_PARTIDA")
    for partida, scope in (("p", ("PARTIDA", "p", "w")), (None, ("GAME", None, None)), (None, ("GAME", None, "w"))):
        add({6: partida, 7: scope})
    none = len(rows)
    add({}, "PLAN_NO_OPERATIONS")
    plans = spark.createDataFrame(rows, PLAN)
    ops = plans.filter(F.col("plan_id") != none).selectExpr("plan_id", "explode(array('a', 'b')) AS operation_id", "'CREATE_ASSERTION' AS op", "'x' AS assertion_id", "'{}' AS payload", "CAST(NULL AS STRING) AS local_override_of")
    ops = ops.withColumn("op_key", admission.digest("plan_id", "operation_id", "op", "assertion_id", "payload"))
    signed = plans.join(admission.operations_summary(ops).select("plan_id", "ops_hash"), "plan_id", "left").withColumn("plan_hash", F.coalesce("ops_hash", F.sha2(F.lit(""), 256))).drop("ops_hash")
    admit = lambda p, o, s="s": {r.plan_id: r.refusals for r in admission.admitted(p, o, "w", s, "2026-01-01T00:00:00Z").collect()}
    assert admit(signed, ops) == want
    assert admit(signed.limit(1), ops, None)[0] == ["PLAN_SNAPSHOT_UNDECLARED"]
    altered = ops.withColumn("payload", F.when(F.col("plan_id") == 0, "{1}").otherwise(F.col("payload"))).withColumn("local_override_of", F.when(F.col("plan_id") == 0, ""))
    assert admit(signed, altered)[0] == ["PLAN_IDEMPOTENCY_KEY_UNDERIVED", "PLAN_LOCAL_OVERRIDE_FROM_GAME_LAYER", "PLAN_SIGNATURE_MISMATCH"]
    assert admission.admitted(signed.limit(0), ops, "w", "s", "2026-01-01T00:00:00Z").count() == 0


def test_gate_names_all_that_fails(spark):
    requests = spark.createDataFrame([(1, 1, "1", True, "op-1", "AB ", 2, "w", "w", True), (2, 9, None, None, "x\n", None, None, None, None, None), (3, 1, "1", True, "op", "ab", 1, "w", "v", True), (4, 1, "1", True, "op", "ab", 0, "w", "w", True)],
        "request_id int, plan_id int, allowed string, apply boolean, operator_id string, confirmed_hash string, max_operations int, env_workspace string, workspace string, audited boolean")
    plans = spark.createDataFrame([(1, "ab", 2)], "plan_id int, plan_hash string, n_ops long")
    got = {r.request_id: r.refusals for r in admission.gate(requests, plans).collect()}
    assert got[1] == [] and got[3] == ["GATE_OPERATION_LIMIT_EXCEEDED", "GATE_WORKSPACE_DECLARATION_MISMATCH"] and got[4] == ["GATE_OPERATION_LIMIT_EXCEEDED"]
    assert got[2] == ["GATE_APPLY_NOT_REQUESTED", "GATE_AUDIT_UNAVAILABLE", "GATE_ENV_NOT_ALLOWED", "GATE_OPERATION_LIMIT_EXCEEDED", "GATE_OPERATOR_INVALID", "GATE_PLAN_HASH_NOT_CONFIRMED", "GATE_WORKSPACE_NOT_DECLARED"]
