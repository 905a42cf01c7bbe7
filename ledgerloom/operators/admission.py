"""Whether a plan may be executed: every rule that it breaks is named, and a rule that cannot be judged counts as broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.scores import codes

# Fixed value: the major version of plans that are executed.
MAJOR = 2


def digest(*columns: str) -> Column:
    """The hash of a row's values; nulls count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def operations_summary(ops: DataFrame) -> DataFrame:
    """plan_id, n_ops, underived (operations whose key is not the hash of what they are), overrides (created assertions that
    declare a local override, an empty one too) and ops_hash of operations (plan_id, operation_id, op, assertion_id,
    payload, local_override_of, op_key).

    ops_hash does not depend on the order of rows: the operations' hashes are summed up, so no plan is gathered.
    """
    own = digest("plan_id", "operation_id", "op", "assertion_id", "payload")
    rows = ops.withColumn("__own", own)
    return rows.groupBy("plan_id").agg(
        F.count("*").alias("n_ops"), F.count_if(~F.col("op_key").eqNullSafe(F.col("__own"))).alias("underived"),
        F.count_if((F.col("op") == "CREATE_ASSERTION") & F.col("local_override_of").isNotNull()).alias("overrides"),
        F.sha2(F.sum(F.conv(F.substring("__own", 1, 15), 16, 10).cast("decimal(38,0)")).cast("string"), 256).alias("ops_hash"),
    )


def scope_incoherent(partida: Column, scope: Column, workspace: Column) -> Column:
    """Whether a plan contradicts itself on its scope: a part of a game without a scope, a layer that is none, a part that
    only one of both sides names or that they name differently, a part in the game's own layer, or another game."""
    layer, part, game = scope["layer"], scope["partida_id"], scope["game_id"]
    named = F.coalesce(part, F.lit("")) != ""
    wrong = (
        ~F.coalesce(layer.isin("GAME", "PARTIDA"), F.lit(False)) | ((layer == "PARTIDA") & (~named | partida.isNull())) | ((layer == "GAME") & part.isNotNull())
        | F.coalesce(game != workspace, F.lit(False)) | F.coalesce(partida != part, F.lit(False))
    )
    return F.when(scope.isNull(), partida.isNotNull()).otherwise(F.coalesce(wrong, F.lit(True)))


def admitted(plans: DataFrame, ops: DataFrame, workspace: str, snapshot: str | None, now: str) -> DataFrame:
    """plan_id, refusals (sorted codes; none: the plan is admitted) of plans.

    plans: plan_id, version, approved, approver, validators (array of results), plan_hash (of ops_hash), expires_at (ISO),
    workspace, partida_id, scope (struct of layer, partida_id, game_id), snapshot_id. ops: those of operations_summary. The
    context is the executor's workspace, the snapshot in force (null: undeclared, which refuses all) and the time.
    """
    rows = plans.join(operations_summary(ops), "plan_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    c = F.col
    effective = F.coalesce(c("scope")["partida_id"], c("partida_id"))
    expires = F.try_to_timestamp(c("expires_at"))
    some = F.coalesce("n_ops", F.lit(0)) > 0
    refusals = codes(
        (~yes(F.try_element_at(F.split("version", r"\."), F.lit(1)).try_cast("int") == MAJOR), "PLAN_CONTRACT_VERSION_UNSUPPORTED"), (~yes(c("approved")), "PLAN_NOT_APPROVED"), (~yes(c("approver") == "LOCAL"), "PLAN_NOT_SIGNED_LOCALLY"),
        (~yes((F.size("validators") > 0) & F.forall("validators", lambda v: F.coalesce(v == "PASS", F.lit(False)))), "PLAN_VALIDATOR_CHAIN_NOT_PASS"),
        (~yes(c("plan_hash") == F.coalesce("ops_hash", F.sha2(F.lit(""), 256))), "PLAN_SIGNATURE_MISMATCH"), (F.coalesce("underived", F.lit(0)) > 0, "PLAN_IDEMPOTENCY_KEY_UNDERIVED"),
        (expires.isNull(), "PLAN_EXPIRY_UNREADABLE"), (yes(F.lit(now).cast("timestamp") >= expires), "PLAN_EXPIRED"), (~yes(c("workspace") == workspace), "PLAN_WORKSPACE_MISMATCH"),
        (scope_incoherent(c("partida_id"), c("scope"), c("workspace")), "PLAN_SCOPE_CROSS_PARTIDA"), (effective.isNull() & (F.coalesce("overrides", F.lit(0)) > 0), "PLAN_LOCAL_OVERRIDE_FROM_GAME_LAYER"),
        (F.lit(not snapshot), "PLAN_SNAPSHOT_UNDECLARED"), (F.lit(bool(snapshot)) & ~yes(c("snapshot_id") == snapshot), "PLAN_SNAPSHOT_STALE"), (~some, "PLAN_NO_OPERATIONS"),
    )
    return rows.select("plan_id", refusals.alias("refusals"))


# Fixed value: the form of an operator's name.
OPERATOR = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,63}\z"


def gate(requests: DataFrame, plans: DataFrame) -> DataFrame:
    """request_id and refusals (sorted codes; none: the plan may be written) of an operator's requests.

    requests: request_id, plan_id, allowed (what the environment says: 1 allows), apply, operator_id, confirmed_hash,
    max_operations, env_workspace, workspace, audited. plans: plan_id, plan_hash, n_ops. All conditions are independent and
    all that fail are named; a plan that is not there confirms no hash.
    """
    rows = requests.join(plans, "plan_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    c = F.col
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    confirmed = F.lower(F.trim("confirmed_hash"))
    refusals = codes(
        (~yes(c("allowed") == "1"), "GATE_ENV_NOT_ALLOWED"), (~yes(c("apply")), "GATE_APPLY_NOT_REQUESTED"), (blank("operator_id"), "GATE_OPERATOR_MISSING"), (~blank("operator_id") & ~c("operator_id").rlike(OPERATOR), "GATE_OPERATOR_INVALID"),
        (~yes((confirmed != "") & (confirmed == c("plan_hash"))), "GATE_PLAN_HASH_NOT_CONFIRMED"), (~yes((c("max_operations") >= 1) & (F.coalesce("n_ops", F.lit(0)) <= c("max_operations"))), "GATE_OPERATION_LIMIT_EXCEEDED"),
        (blank("env_workspace"), "GATE_WORKSPACE_NOT_DECLARED"), (~blank("env_workspace") & ~yes(c("env_workspace") == c("workspace")), "GATE_WORKSPACE_DECLARATION_MISMATCH"), (~yes(c("audited")), "GATE_AUDIT_UNAVAILABLE"),
    )
    return rows.select("request_id", refusals.alias("refusals"))
