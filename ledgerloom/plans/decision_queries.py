"""Queries on cues, claims, decisions, reconciliation, routing, scoped visibility and Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import cues
from ledgerloom.functions.scores import first_that
from ledgerloom.operators import decision, graph, markdown, policy
from ledgerloom.plans.graph_queries import NODES
from ledgerloom.plans.text_queries import fold
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- cues

def cased(rules, otherwise):
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '(^| )({x})( |$)') THEN '{v}'" for v, x in rules) + f" ELSE '{otherwise}' END"


@query("temporal_states", f"WITH d AS (SELECT lang, {fold('text')} AS t FROM documents WHERE text IS NOT NULL) SELECT lang, {cased(cues.TEMPORAL, 'UNKNOWN')} AS state, count(*) AS n FROM d GROUP BY ALL")
def temporal_states(spark, sf):
    return table(spark, sf, "documents").filter("text IS NOT NULL").groupBy("lang", cues.temporal_state(F.col("text")).alias("state")).agg(F.count("*").alias("n"))


@query("epistemic_states", f"""WITH d AS (SELECT lang, {fold('text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT lang, {cased([(s, x) for s, _, x in cues.EPISTEMIC], 'ASSERTED')} AS status, {cased([(m, x) for _, m, x in cues.EPISTEMIC], 'assertion')} AS nuance, count(*) AS n FROM d GROUP BY ALL""")
def epistemic_states(spark, sf):
    status, nuance = cues.epistemic_state(F.col("text"))
    return table(spark, sf, "documents").filter("text IS NOT NULL").groupBy("lang", status.alias("status"), nuance.alias("nuance")).agg(F.count("*").alias("n"))


# ---- claims: every lineitem says something of a supplier and a part

PROFILE = [("MAKES", False, "MADE_BY", ["supplier"], ["part"]), ("MADE_BY", False, "MAKES", ["part"], ["supplier"]), ("NEAR", True, None, [], []), ("OWNS", False, None, ["customer"], ["part"])]
CLAIMS = """c AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, 'supplier:' || l_suppkey AS subject, 'part:' || l_partkey AS object,
  CASE WHEN l_linenumber = 1 THEN 'MAKES' WHEN l_linenumber = 2 THEN 'MADE_BY' WHEN l_linenumber = 3 THEN 'NEAR' WHEN l_linenumber = 4 THEN 'OWNS' WHEN l_linenumber = 5 THEN 'LIKES' END AS predicate,
  CASE WHEN l_linestatus = 'O' THEN 'DIRECT' ELSE 'INVERSE' END AS direction, round(1 - l_discount * 6, 6) AS confidence, l_tax AS tax, CAST(l_quantity AS BIGINT) // 10 AS n_evidence, l_returnflag AS flag,
  CASE WHEN l_tax > 0.07 THEN 'CESSATION' WHEN l_tax > 0.06 THEN 'DENIAL' END AS negation FROM lineitem)"""


def claims(spark, sf):
    n, tax = F.col("l_linenumber"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("claim_id"), F.concat(F.lit("supplier:"), "l_suppkey").alias("subject"), F.concat(F.lit("part:"), "l_partkey").alias("object"),
        first_that((n == 1, "MAKES"), (n == 2, "MADE_BY"), (n == 3, "NEAR"), (n == 4, "OWNS"), (n == 5, "LIKES"), otherwise=None).alias("predicate"),
        F.when(F.col("l_linestatus") == "O", "DIRECT").otherwise("INVERSE").alias("direction"), F.round(1 - F.col("l_discount") * 6, 6).alias("confidence"), tax.alias("tax"),
        F.floor(F.col("l_quantity") / 10).alias("n_evidence"), F.col("l_returnflag").alias("flag"), first_that((tax > 0.07, "CESSATION"), (tax > 0.06, "DENIAL"), otherwise=None).alias("negation"),
    )


def profile(spark):
    return spark.createDataFrame(PROFILE, "predicate string, symmetric boolean, inverse_of string, domain array<string>, range array<string>")


RULES_SQL = [
    ("n_evidence = 0", "REJECT", "evidence_missing"), ("confidence < 0.5", "ABSTAIN", "claim_low_confidence"), ("flag = 'R'", "REVIEW", "extractor_review"), ("predicate IS NULL", "ABSTAIN", "predicate_missing"),
    ("fit = 'unknown_predicate' AND predicate IS NOT NULL", "REJECT", "predicate_unknown"), ("fit = 'none'", "REJECT", "type_incompatible"), ("fit = 'backward'", "WARN", "direction_flipped"),
    ("negation = 'DENIAL'", "REVIEW", "negated"), ("tax < 0.01", "INFO", "low_tax"),
]
FIT = "CASE WHEN predicate = 'MAKES' THEN 'forward' WHEN predicate = 'MADE_BY' THEN 'backward' WHEN predicate = 'NEAR' THEN 'both' WHEN predicate = 'OWNS' THEN 'none' ELSE 'unknown_predicate' END AS fit"
ENGINE = f"""{CLAIMS}, f AS (SELECT *, {FIT} FROM c),
w AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN {{'s': {decision.SEVERITIES.index(s)}, 'c': '{k}'}} END" for c, s, k in RULES_SQL)}], lambda x: x IS NOT NULL) AS found FROM f),
g AS (SELECT *, coalesce(list_max(list_transform(found, lambda x: x.s)), 0) AS worst FROM w),
d AS (SELECT *, ['ACCEPT', 'ACCEPT', 'REVIEW', 'ABSTAIN', 'REJECT_INVALID'][worst + 1] AS first, array_to_string(list_sort(list_transform(list_filter(found, lambda x: x.s = worst), lambda x: x.c)), ',') AS codes FROM g)"""


def judged(spark, sf):
    rows = decision.typed(claims(spark, sf).withColumn("subject_type", F.lit("supplier")).withColumn("object_type", F.lit("part")), profile(spark))
    fit = F.col("fit")
    rules = [
        ("evidence", "REJECT", "evidence_missing", F.col("n_evidence") == 0), ("claim", "ABSTAIN", "claim_low_confidence", F.col("confidence") < 0.5), ("claim", "REVIEW", "extractor_review", F.col("flag") == "R"),
        ("predicate", "ABSTAIN", "predicate_missing", F.col("predicate").isNull()), ("predicate", "REJECT", "predicate_unknown", (fit == "unknown_predicate") & F.col("predicate").isNotNull()),
        ("predicate", "REJECT", "type_incompatible", fit == "none"), ("direction", "WARN", "direction_flipped", fit == "backward"), ("negation", "REVIEW", "negated", F.col("negation") == "DENIAL"), ("authority", "INFO", "low_tax", F.col("tax") < 0.01),
    ]
    return decision.decided(rows, rules, ["subject", "object", "predicate", "direction"])


@query("claim_engine", f"WITH {ENGINE} SELECT claim_id, first AS decision, codes AS reasons FROM d")
def claim_engine(spark, sf):
    return judged(spark, sf).select("claim_id", "decision", "reasons")


@query("claim_shadow", f"""WITH {ENGINE}, s AS (SELECT first AS decision, ['ACCEPT', 'ACCEPT', 'REVIEW', 'ABSTAIN', 'REJECT_INVALID'][coalesce(list_max(list_transform(list_filter(found, lambda x: x.c NOT IN ('claim_low_confidence', 'extractor_review', 'negated')), lambda x: x.s)), 0) + 1] AS shadow FROM d)
SELECT decision, shadow, count(*) AS n FROM s GROUP BY ALL""")
def claim_shadow(spark, sf):
    return decision.shadow(judged(spark, sf), ["claim", "negation"]).groupBy("decision", "shadow").agg(F.count("*").alias("n"))


KEYS = f"""{CLAIMS}, k AS (SELECT *, direction = 'INVERSE' AS swap, coalesce(predicate = 'MAKES', false) AS fold FROM c),
t AS (SELECT *, CASE WHEN swap <> fold THEN object ELSE subject END AS a, CASE WHEN swap <> fold THEN subject ELSE object END AS b, CASE WHEN fold THEN 'MADE_BY' ELSE predicate END AS name FROM k),
keyed AS (SELECT claim_id, predicate, negation, concat_ws('|', CASE WHEN name = 'NEAR' THEN least(a, b) ELSE a END, name, CASE WHEN name = 'NEAR' THEN greatest(a, b) ELSE b END) AS canonical_key FROM t)"""


@query("claim_canonical", f"WITH {KEYS} SELECT canonical_key, count(*) AS claims, min(claim_id) AS first_claim FROM keyed GROUP BY canonical_key")
def claim_canonical(spark, sf):
    return decision.canonical(claims(spark, sf), profile(spark)).groupBy("canonical_key").agg(F.count("*").alias("claims"), F.min("claim_id").alias("first_claim"))


@query("claim_negations", f"""WITH {KEYS}, p AS (SELECT canonical_key, count(*) AS positives, min(claim_id) AS single FROM keyed WHERE negation IS NULL GROUP BY ALL), n AS (SELECT claim_id, negation, coalesce(positives, 0) AS positives, single FROM keyed LEFT JOIN p USING (canonical_key)),
o AS (SELECT *, CASE WHEN negation IS NULL THEN 'POSITIVE' WHEN negation = 'CESSATION' THEN CASE WHEN positives = 1 THEN 'CLOSES' WHEN positives > 1 THEN 'AMBIGUOUS_CESSATION' ELSE 'NOTHING_TO_CLOSE' END WHEN positives > 0 THEN 'CONFLICT' ELSE 'NEGATIVE' END AS outcome FROM n)
SELECT claim_id, outcome, CASE WHEN outcome = 'CLOSES' THEN single END AS closes FROM o""")
def claim_negations(spark, sf):
    rows = decision.canonical(claims(spark, sf), profile(spark))
    live = rows.filter("negation IS NULL").select("canonical_key", F.col("claim_id").alias("assertion_id"))
    return decision.negations(rows, live).select("claim_id", "outcome", "closes")


@query("claim_temporality", """WITH c AS (SELECT l_returnflag, CASE WHEN l_linenumber <> 2 THEN l_shipdate END AS s, CASE WHEN l_linenumber IN (3, 4) THEN o_orderdate + INTERVAL 60 DAYS END AS e, l_linenumber = 5 AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_returnflag AS flag, CASE WHEN e < s THEN 'INVERTED' WHEN r THEN 'RECURRING' WHEN e IS NOT NULL THEN 'ENDED' WHEN s IS NOT NULL THEN 'ACTIVE' ELSE 'UNKNOWN' END AS state, count(*) AS n FROM c GROUP BY ALL""")
def claim_temporality(spark, sf):
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    state = decision.temporality(F.when(n != 2, F.col("l_shipdate")), F.when(n.isin(3, 4), F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")), n == 5)
    return rows.groupBy(F.col("l_returnflag").alias("flag"), state.alias("state")).agg(F.count("*").alias("n"))


@query("evidence_floors", "SELECT l_orderkey, round(least(max(l_quantity) / 50, min(1 - l_discount * 5)), 6) AS floor FROM lineitem GROUP BY l_orderkey")
def evidence_floors(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.max("l_quantity") / 50).alias("q"), F.array(F.min(1 - F.col("l_discount") * 5)).alias("fragments"))
    return rows.select("l_orderkey", F.round(decision.evidence_floor(F.col("q"), F.col("fragments")), 6).alias("floor"))


@query("entity_creation", f"""WITH p AS (SELECT p_partkey, {fold('p_name')} AS surface, round(p_size / 50.0::DOUBLE, 6) AS confidence, p_brand FROM part), r AS (SELECT *, lead(confidence) OVER (PARTITION BY p_brand ORDER BY confidence DESC, p_partkey) AS rival FROM p)
SELECT p_partkey, 'ent_' || left(sha256(concat_ws(chr(31), 'w', surface, 'part')), 16) AS entity_id, CASE WHEN confidence < 0.5 THEN 'ABSTAIN' WHEN p_partkey % 2 = 0 AND confidence >= 0.75 AND coalesce(rival, 0) <= confidence - 0.15 THEN 'CREATE_NEW' ELSE 'CREATE_PROVISIONAL' END AS action FROM r""")
def entity_creation(spark, sf):
    from pyspark.sql import Window

    from ledgerloom.functions import text as T

    rows = table(spark, sf, "part").select("p_partkey", T.fold(F.col("p_name")).alias("surface"), F.round(F.col("p_size") / 50, 6).alias("confidence"), "p_brand")
    rival = F.lead("confidence").over(Window.partitionBy("p_brand").orderBy(F.col("confidence").desc(), "p_partkey"))
    rows = rows.withColumn("rival", rival)
    return rows.select("p_partkey", decision.derived_id("ent", F.lit("w"), F.col("surface"), F.lit("part")).alias("entity_id"), decision.creation(F.col("confidence"), F.col("p_partkey") % 2 == 0, F.col("rival")).alias("action"))


@query("candidate_auto_decisions", """WITH c AS (SELECT p_partkey, round(p_size / 50.0::DOUBLE, 6) AS c, p_retailprice > 1000 AS valid, count(*) OVER (PARTITION BY p_name) > 1 AS dup, p_brand LIKE '%3' AS amb FROM part)
SELECT p_partkey, CASE WHEN NOT valid THEN 'reject' WHEN dup THEN 'merge' WHEN c < 0.6 THEN 'reject' WHEN amb OR c < 0.85 THEN 'review' ELSE 'approve' END AS decision,
  CASE WHEN NOT valid THEN 'invalid' WHEN dup THEN 'duplicate' WHEN c < 0.6 THEN 'low_confidence' WHEN amb THEN 'ambiguous' WHEN c < 0.85 THEN 'medium_confidence' ELSE 'high_confidence' END AS reason FROM c""")
def candidate_auto_decisions(spark, sf):
    part = table(spark, sf, "part")
    many = part.groupBy("p_name").agg((F.count("*") > 1).alias("dup"))
    what, why = decision.automatic(F.round(F.col("p_size") / 50, 6), F.col("p_retailprice") > 1000, F.col("dup"), F.col("p_brand").like("%3"))
    return part.join(many, "p_name").select("p_partkey", what.alias("decision"), why.alias("reason"))


# ---- reconciliation and routing

FAMILIES = [("AF", "model"), ("RF", "model"), ("NO", "rules")]


@query("reconciled_mentions", """WITH m AS (SELECT l_suppkey, l_partkey, l_discount, l_orderkey, l_tax > 0.02 AS review, CASE WHEN l_returnflag || l_linestatus IN ('AF', 'RF') THEN 'model' WHEN l_returnflag || l_linestatus = 'NO' THEN 'rules' ELSE 'unknown' END AS family FROM lineitem)
SELECT l_suppkey, l_partkey, max(l_discount) AS confidence, count(*) AS proposals, count(DISTINCT l_orderkey) AS evidence, string_agg(DISTINCT family, ',' ORDER BY family) AS families, bool_and(review) AS all_review, CAST(count(DISTINCT family) AS INTEGER) AS independent FROM m GROUP BY ALL""")
def reconciled_mentions(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", F.col("l_discount").alias("confidence"), F.concat("l_returnflag", "l_linestatus").alias("origin"), F.col("l_orderkey").alias("evidence_id"), (F.col("l_tax") > 0.02).alias("review"))
    return decision.reconciled(rows, ["l_suppkey", "l_partkey"], spark.createDataFrame(FAMILIES, "origin string, family string"))


PROVIDERS = [("rules", 0, "extract", False, 50_000), ("small", 1, "extract", False, 200_000), ("cloud", 2, "extract", True, 10_000_000), ("ocr", 1, "read", False, 300_000), ("cloud", 2, "read", True, 10_000_000)]


@query("provider_routes", f"""WITH p(name, tier, has, external, max_size) AS (VALUES {', '.join(map(str, PROVIDERS))}), r AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'F' THEN 'read' ELSE 'extract' END AS capability, o_orderpriority LIKE '1%' AS private, o_totalprice AS size FROM orders)
SELECT request_id, arg_min(name, (tier, name)) AS provider, count(name) AS considered FROM r LEFT JOIN p ON capability = has AND size <= max_size AND NOT (private AND external) GROUP BY request_id""")
def provider_routes(spark, sf):
    requests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "F", "read").otherwise("extract").alias("capability"), F.col("o_orderpriority").like("1%").alias("private"), F.col("o_totalprice").alias("size"))
    return decision.routed(requests, spark.createDataFrame(PROVIDERS, "name string, tier int, capability string, external boolean, max_size long"))


# ---- visibility with scopes and games

@query("visibility_scoped", f"""WITH {NODES}, r AS (SELECT *, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 3 = 0 THEN 'lore' ELSE 'game' END AS scope, CASE WHEN k % 3 <> 0 OR k % 21 = 0 THEN 'g' || k % 4 END AS game_id, CASE WHEN k % 5 <> 0 THEN k % 20 END AS known_from, CASE WHEN k % 17 = 0 THEN ['hero'] ELSE [] END AS known_by FROM nodes)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN visibility IS NULL THEN 'visibility_invalid' WHEN workspace NOT IN ('w1', 'w2', 'w3') THEN 'workspace_not_allowed' WHEN scope IS NULL THEN 'scope_invalid'
  WHEN scope = 'game' AND game_id IS NULL THEN 'game_blank' WHEN scope = 'game' AND game_id NOT IN ('g1', 'g2') THEN 'game_not_allowed' WHEN scope = 'lore' AND game_id IS NOT NULL THEN 'scope_contradiction'
  WHEN NOT list_contains(known_by, 'hero') AND visibility IN ('secret') THEN 'secret_not_allowed' WHEN NOT list_contains(known_by, 'hero') AND visibility = 'narrator' THEN 'narrator_only'
  WHEN scope = 'game' AND known_from IS NULL THEN 'known_from_missing' WHEN known_from > 9 THEN 'future_session' ELSE 'visible' END AS reason FROM r) GROUP BY reason""")
def visibility_scoped(spark, sf):
    k = F.split("node_id", ":")[1].cast("long")
    rows = graph.nodes(spark, sf).withColumns({
        "scope": first_that((k % 13 == 0, None), (k % 3 == 0, "lore"), otherwise="game"), "game_id": F.when((k % 3 != 0) | (k % 21 == 0), F.concat(F.lit("g"), (k % 4).cast("string"))),
        "known_from": F.when(k % 5 != 0, k % 20), "known_by": F.when(k % 17 == 0, F.array(F.lit("hero"))).otherwise(F.array().cast("array<string>")),
    })
    viewer = policy.Viewer(("w1", "w2", "w3"), sees_reference=True, max_session=9, games=("g1", "g2"), character="hero", sees_lore=True)
    return rows.groupBy(policy.scoped_reason(viewer).alias("reason")).agg(F.count("*").alias("n"))


# ---- Markdown

@query("markdown_blocks", r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, CASE WHEN trim(line, ' ' || chr(9)) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(line, '^ *([-*+]|[0-9]+[.)]) ') THEN 'list' WHEN regexp_matches(line, '^ *>') THEN 'quote' WHEN regexp_matches(line, '^ *[|]') THEN 'table' ELSE 'paragraph' END AS kind FROM l),
s AS (SELECT *, CASE WHEN kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 1 ELSE 0 END AS starts FROM k),
b AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM s)
SELECT doc_id, CAST(min(line_no) AS INTEGER) AS first_line, kind, count(*) AS lines FROM b WHERE kind <> 'blank' GROUP BY doc_id, block, kind""")
def markdown_blocks(spark, sf):
    return markdown.blocks(table(spark, sf, "documents")).select("doc_id", "first_line", "kind", "lines")
