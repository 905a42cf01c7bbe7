"""The decision engine: findings of rules on each claim, the decision of the worst, and what leads to them.

All rules are expressions over one row of a claim that was joined with what it is about; a claim's findings are one array,
so a decision is one projection whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.scores import first_that

# Severities from mild to grave, and the decision that the worst one leads to.
SEVERITIES = ["INFO", "WARN", "REVIEW", "ABSTAIN", "REJECT"]
DECISIONS = ["ACCEPT", "ACCEPT", "REVIEW", "ABSTAIN", "REJECT_INVALID"]
#: Below this confidence nothing is accepted.
FLOOR = 0.5

FINDING = "array<struct<axis:string,severity:int,code:string>>"


def finding(axis: str, severity: str, code: str, when: Column) -> Column:
    """An array with the finding if it holds (null does not hold), else an empty one."""
    one = F.array(F.struct(F.lit(axis).alias("axis"), F.lit(SEVERITIES.index(severity)).alias("severity"), F.lit(code).alias("code")))
    return F.when(when, one).otherwise(F.lit(None).cast(FINDING))


def findings(*rules: tuple[str, str, str, Column]) -> Column:
    """The findings of all rules (axis, severity, code, condition) that hold."""
    every = F.array(*[finding(*r) for r in rules])
    return F.flatten(F.filter(every, lambda x: x.isNotNull()))


def worst(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda f: f["severity"])), F.lit(0))


def decision(found: Column) -> Column:
    return F.get(F.array(*map(F.lit, DECISIONS)), worst(found))


def worst_codes(found: Column) -> Column:
    """Sorted codes of the worst severity."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda f: f["severity"] == worst(found)), lambda f: f["code"]))), ",")


def decided(claims: DataFrame, rules: list[tuple[str, str, str, Column]], slots: list[str]) -> DataFrame:
    """claims with findings, decision, reasons. Whatever the findings, an acceptance needs the confidence FLOOR, evidence
    (n_evidence) and all slots; without them it becomes a review, with the reason invariant."""
    rows = claims.withColumn("findings", findings(*rules))
    rows = rows.withColumn("decision", decision(F.col("findings"))).withColumn("reasons", worst_codes(F.col("findings")))
    whole = (F.col("confidence") >= FLOOR) & (F.col("n_evidence") > 0)
    for s in slots:
        whole &= F.col(s).isNotNull()
    fails = (F.col("decision") == "ACCEPT") & ~F.coalesce(whole, F.lit(False))
    return rows.withColumn("reasons", F.when(fails, "invariant").otherwise(F.col("reasons"))).withColumn("decision", F.when(fails, "REVIEW").otherwise(F.col("decision")))


def shadow(claims: DataFrame, ignored: list[str]) -> DataFrame:
    """claims with shadow: what the decision would be without the findings of these axes."""
    left = F.filter("findings", lambda f: ~f["axis"].isin(*ignored))
    return claims.withColumn("shadow", decision(left))


def evidence_floor(quality: Column, fragments: Column) -> Column:
    """The least of an episode's quality and its fragments' confidences; null without either."""
    return F.least(quality, F.array_min(fragments))


# ---- ontology

def canonical(claims: DataFrame, profile: DataFrame) -> DataFrame:
    """claims (subject, object, predicate, direction) with one key for all ways to say the same: INVERSE swaps the ends; a
    predicate with an inverse is told as the one that comes first in the alphabet; symmetric ones have their ends in order.
    profile (predicate, symmetric, inverse_of) has one row a predicate of the ontology and is broadcast."""
    rows = claims.join(F.broadcast(profile.select("predicate", "symmetric", "inverse_of")), "predicate", "left")
    swap = F.col("direction") == "INVERSE"
    fold = F.coalesce(F.col("inverse_of") < F.col("predicate"), F.lit(False))
    turned = swap != fold
    a, b = F.when(turned, F.col("object")).otherwise(F.col("subject")), F.when(turned, F.col("subject")).otherwise(F.col("object"))
    even = F.coalesce("symmetric", F.lit(False))
    name = F.when(fold, F.col("inverse_of")).otherwise(F.col("predicate"))
    return rows.select(*claims.columns, F.concat_ws("|", F.when(even, F.least(a, b)).otherwise(a), name, F.when(even, F.greatest(a, b)).otherwise(b)).alias("canonical_key"))


def typed(claims: DataFrame, profile: DataFrame) -> DataFrame:
    """claims (predicate, subject_type, object_type) with fit: forward, backward, both, none, or unknown_predicate.
    profile (predicate, domain, range: arrays of types; an empty one admits all) is broadcast."""
    rows = claims.join(F.broadcast(profile.select("predicate", "domain", "range", F.lit(True).alias("known"))), "predicate", "left")
    ok = lambda types, t: (F.size(types) == 0) | F.array_contains(types, F.col(t))
    ahead = ok("domain", "subject_type") & ok("range", "object_type")
    back = ok("domain", "object_type") & ok("range", "subject_type")
    fit = first_that((F.col("known").isNull(), "unknown_predicate"), (ahead & back, "both"), (ahead, "forward"), (back, "backward"), otherwise="none")
    return rows.select(*claims.columns, fit.alias("fit"))


def temporality(start: Column, end: Column, recurring: Column) -> Column:
    """INVERTED, RECURRING, ENDED, ACTIVE or UNKNOWN by a claim's bounds."""
    return first_that((end < start, "INVERTED"), (recurring, "RECURRING"), (end.isNotNull(), "ENDED"), (start.isNotNull(), "ACTIVE"), otherwise="UNKNOWN")


def negations(claims: DataFrame, live: DataFrame) -> DataFrame:
    """claims (claim_id, canonical_key, negation: null, CESSATION or DENIAL) with outcome: a cessation closes the one live
    positive assertion of its key, needs a review where there are several and abstains where there is none; a denial
    conflicts with any. live (canonical_key, assertion_id) are the live positive assertions; they are counted by key
    before the join."""
    counts = live.groupBy("canonical_key").agg(F.count("*").alias("positives"), F.min("assertion_id").alias("only"))
    rows = claims.join(counts, "canonical_key", "left").withColumn("positives", F.coalesce("positives", F.lit(0)))
    stops = F.col("negation") == "CESSATION"
    outcome = first_that(
        (F.col("negation").isNull(), "POSITIVE"), (stops & (F.col("positives") == 1), "CLOSES"), (stops & (F.col("positives") > 1), "AMBIGUOUS_CESSATION"),
        (stops, "NOTHING_TO_CLOSE"), (F.col("positives") > 0, "CONFLICT"), otherwise="NEGATIVE",
    )
    return rows.select(*claims.columns, outcome.alias("outcome"), F.when(outcome == "CLOSES", F.col("only")).alias("closes"))


# ---- entities and candidates of the first version

def derived_id(prefix: str, *parts: Column, digits: int = 16) -> Column:
    """A stable id from the parts' hash."""
    return F.concat(F.lit(f"{prefix}_"), F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(digits)))


def creation(confidence: Column, is_name: Column, rival: Column, least: float = 0.75, margin: float = 0.15) -> Column:
    """CREATE_NEW for a sure name without a close rival, else CREATE_PROVISIONAL; below half nothing is made."""
    return first_that((confidence < 0.5, "ABSTAIN"), (is_name & (confidence >= least) & (F.coalesce(rival, F.lit(0.0)) <= confidence - margin), "CREATE_NEW"), otherwise="CREATE_PROVISIONAL")


def automatic(confidence: Column, valid: Column, duplicate: Column, ambiguous: Column) -> tuple[Column, Column]:
    """(decision, reason) of a candidate: the first rule that applies decides."""
    rules = [(~valid, "reject", "invalid"), (duplicate, "merge", "duplicate"), (confidence < 0.6, "reject", "low_confidence"), (ambiguous, "review", "ambiguous"), (confidence < 0.85, "review", "medium_confidence")]
    return first_that(*[(c, d) for c, d, _ in rules], otherwise="approve"), first_that(*[(c, r) for c, _, r in rules], otherwise="high_confidence")


# ---- reconciliation

def reconciled(rows: DataFrame, key: list[str], families: DataFrame) -> DataFrame:
    """One row for each key of proposals (key, confidence, origin, evidence_id, review): the best confidence, numbers of
    proposals, of distinct pieces of evidence and of independent families, and whether all ask for a review. families
    (origin, family) is a rule table and broadcast; an origin without a rule is of the family unknown. Sums are made before
    the shuffle, so a key with any number of proposals is never gathered."""
    of = rows.join(F.broadcast(families), "origin", "left").withColumn("family", F.coalesce("family", F.lit("unknown")))
    out = of.groupBy(*key).agg(
        F.max("confidence").alias("confidence"), F.count("*").alias("proposals"), F.count_distinct("evidence_id").alias("evidence"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.bool_and("review").alias("all_review"),
    )
    return out.withColumn("independent", F.size(F.split("families", ",")))


# ---- routing

def routed(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """request_id, provider (null if none may) and considered of requests (request_id, capability, private, size): the first
    provider (name, tier, capability, external, max_size) by tier and name that has the capability and the size; private
    requests stay off external ones. providers is a configuration table and broadcast."""
    fits = (F.col("capability") == F.col("has")) & (F.col("size") <= F.col("max_size")) & ~(F.col("private") & F.col("external"))
    p = F.broadcast(providers.withColumnRenamed("capability", "has"))
    pairs = requests.join(p, fits, "left")
    return pairs.groupBy("request_id").agg(F.min(F.struct("tier", "name")).alias("best"), F.count("name").alias("considered")).select("request_id", F.col("best.name").alias("provider"), "considered")
