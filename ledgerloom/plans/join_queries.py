"""Queries on evidence, overrides, conflicts, spans, merges and what is scored from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import decision, joins
from ledgerloom.plans.decision_queries import ENGINE, KEYS, claims, judged, profile
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


@query("evidence_literal", """WITH f AS (SELECT doc_id, doc_id % 40 AS s, doc_id % 40 + 20 AS e, CASE WHEN lang = 'de' THEN upper(substring(text, doc_id % 40 + 1, 20)) ELSE substring(text, doc_id % 40 + 1, 20) END AS literal, CASE WHEN source LIKE '%a%' THEN source ELSE 'x' END AS asset, source, text FROM documents)
SELECT doc_id AS fragment_id, CASE WHEN text IS NULL THEN 'unknown_text' WHEN asset IS DISTINCT FROM source THEN 'foreign_asset' WHEN e > length(text) THEN 'out_of_bounds' WHEN substring(text, s + 1, 20) <> literal THEN 'not_literal' ELSE 'verified' END AS status FROM f""")
def evidence_literal(spark, sf):
    docs = table(spark, sf, "documents")
    start = (F.col("doc_id") % 40).cast("int")
    cut = F.substring("text", start + 1, F.lit(20))
    fragments = docs.select(F.col("doc_id").alias("fragment_id"), F.col("doc_id").alias("text_id"), F.when(F.col("source").like("%a%"), F.col("source")).otherwise("x").alias("asset"), start.alias("start"), (start + 20).alias("end"), F.when(F.col("lang") == "de", F.upper(cut)).otherwise(cut).alias("literal"))
    return joins.literal_evidence(fragments, docs.select(F.col("doc_id").alias("text_id"), F.col("source").alias("asset"), "text")).select("fragment_id", "status")


@query("visible_facts", """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id, CASE WHEN l_linenumber > 2 THEN 'w' || l_suppkey % 3 END AS scope, CASE WHEN l_linenumber = 3 THEN l_orderkey * 10 + 1 WHEN l_linenumber = 4 THEN l_orderkey * 10 + 2 END AS overrides FROM lineitem)
SELECT fact_id, scope FROM f WHERE scope = 'w1' OR (scope IS NULL AND fact_id NOT IN (SELECT overrides FROM f WHERE scope = 'w1' AND overrides IS NOT NULL))""")
def visible_facts(spark, sf):
    n, key = F.col("l_linenumber"), F.col("l_orderkey") * 10
    facts = table(spark, sf, "lineitem").select((key + n).alias("fact_id"), F.when(n > 2, F.concat(F.lit("w"), (F.col("l_suppkey") % 3).cast("string"))).alias("scope"), F.when(n == 3, key + 1).when(n == 4, key + 2).alias("overrides"))
    return joins.visible_facts(facts, "w1").select("fact_id", "scope")


@query("claim_batch_conflicts", f"""WITH {KEYS}, n AS (SELECT claim_id, canonical_key, negation IS NOT NULL AS negated FROM keyed)
SELECT claim_id, CASE WHEN opposite IS NOT NULL THEN 'contradiction' WHEN same < claim_id THEN 'duplicate' ELSE 'alone' END AS finding, CASE WHEN opposite IS NOT NULL THEN opposite WHEN same < claim_id THEN same END AS other
FROM (SELECT claim_id, CASE WHEN negated THEN yes ELSE no END AS opposite, CASE WHEN negated THEN no ELSE yes END AS same FROM (SELECT *, min(CASE WHEN negated THEN claim_id END) OVER w AS no, min(CASE WHEN NOT negated THEN claim_id END) OVER w AS yes FROM n WINDOW w AS (PARTITION BY canonical_key)))""")
def claim_batch_conflicts(spark, sf):
    keyed = decision.canonical(claims(spark, sf), profile(spark)).select("claim_id", "canonical_key", F.col("negation").isNotNull().alias("negated"))
    return joins.batch_conflicts(keyed).select("claim_id", "finding", "other")


@query("span_pairs", """WITH s AS (SELECT l_suppkey AS key, l_orderkey * 10 + l_linenumber AS id, l_partkey * 7 % 5000 AS start, l_partkey * 7 % 5000 + CAST(l_quantity AS BIGINT) AS stop, l_returnflag FROM lineitem),
p AS (SELECT g.key, g.id AS gold_id, q.id AS pred_id, least(g.stop, q.stop) - greatest(g.start, q.start) AS common, g.stop - g.start + q.stop - q.start AS total, g.start <= q.start AND q.stop <= g.stop AS contained FROM s g JOIN s q ON g.key = q.key AND g.start < q.stop AND q.start < g.stop WHERE g.l_returnflag = 'A' AND q.l_returnflag <> 'A')
SELECT key, gold_id, pred_id, round(common / (total - common)::DOUBLE, 6) AS iou, contained FROM p""")
def span_pairs(spark, sf):
    start = F.col("l_partkey") * 7 % 5000
    spans = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), "l_returnflag")
    return joins.span_pairs(spans.filter("l_returnflag = 'A'"), spans.filter("l_returnflag <> 'A'"), 50)


@query("hybrid_merge", """WITH a AS (SELECT p_name AS name, p_brand AS kind, max(round(p_size / 50.0::DOUBLE, 6)) AS ca FROM part WHERE p_size > 20 GROUP BY ALL), b AS (SELECT p_name AS name, p_brand AS kind, max(round(p_size / 60.0::DOUBLE, 6)) AS cb FROM part WHERE p_retailprice > 1200 OR p_size <= 20 GROUP BY ALL)
SELECT coalesce(a.name, b.name) AS name, coalesce(a.kind, b.kind) AS kind, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN 'both' WHEN cb >= 0.5 THEN 'model_only' WHEN cb IS NOT NULL THEN 'model_dropped' WHEN ca >= 0.8 THEN 'rule_only' ELSE 'rule_dropped' END AS outcome, greatest(ca, cb) AS confidence
FROM a FULL JOIN b ON a.name = b.name AND a.kind = b.kind""")
def hybrid_merge(spark, sf):
    part = table(spark, sf, "part").withColumnsRenamed({"p_name": "name", "p_brand": "kind"})
    of = lambda rows, by: rows.select("name", "kind", F.round(F.col("p_size") / by, 6).alias("confidence"))
    return joins.hybrid(of(part.filter("p_size > 20"), 50), of(part.filter("p_retailprice > 1200 OR p_size <= 20"), 60), 0.5, 0.8)


@query("resolution_memory", """WITH m AS (SELECT user_id % 5 AS workspace, CASE WHEN event_type <> 'view' THEN event_type END AS scope, user_id % 40 AS surface, event_id AS entity_id, value AS confidence, ts AS seen FROM events),
b AS (SELECT workspace, scope, surface, arg_max(entity_id, (confidence, seen)) AS entity_id FROM m GROUP BY ALL), q AS (SELECT o_orderkey AS mention_id, o_custkey % 5 AS workspace, CASE WHEN o_orderstatus = 'F' THEN 'purchase' ELSE 'none' END AS scope, o_orderkey % 50 AS surface FROM orders)
SELECT mention_id, coalesce(o.entity_id, s.entity_id) AS entity_id, CASE WHEN o.entity_id IS NOT NULL THEN 'own' WHEN s.entity_id IS NOT NULL THEN 'shared' ELSE 'none' END AS source
FROM q LEFT JOIN b o ON o.workspace = q.workspace AND o.scope = q.scope AND o.surface = q.surface LEFT JOIN b s ON s.scope IS NULL AND s.workspace = q.workspace AND s.surface = q.surface""")
def resolution_memory(spark, sf):
    memory = table(spark, sf, "events").select((F.col("user_id") % 5).alias("workspace"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("scope"), (F.col("user_id") % 40).alias("surface"), F.col("event_id").alias("entity_id"), F.col("value").alias("confidence"), F.col("ts").alias("at"))
    mentions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mention_id"), (F.col("o_custkey") % 5).alias("workspace"), F.when(F.col("o_orderstatus") == "F", "purchase").otherwise("none").alias("scope"), (F.col("o_orderkey") % 50).alias("surface"))
    return joins.remembered(mentions, memory)


@query("glossary_tiers", f"""WITH t AS (SELECT DISTINCT p_name AS term FROM part), f AS (SELECT term, {fold('term')} AS form, 'canonical' AS tier, 0.95::DOUBLE AS score FROM t UNION ALL SELECT term, array_to_string(list_reverse(string_split({fold('term')}, ' ')), ' '), 'variant', 0.9 FROM t UNION ALL SELECT term, {fold('term')} || 's', 'error', 0.8 FROM t),
m AS (SELECT p_partkey AS mention_id, CASE p_partkey % 4 WHEN 0 THEN {fold('p_name')} WHEN 1 THEN array_to_string(list_reverse(string_split({fold('p_name')}, ' ')), ' ') WHEN 2 THEN {fold('p_name')} || 's' ELSE 'no such' END AS surface FROM part),
r AS (SELECT mention_id, term, tier, score, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, term, tier) AS rk FROM m JOIN f ON surface = form) SELECT mention_id, term, tier, score FROM r WHERE rk = 1""")
def glossary_tiers(spark, sf):
    part = table(spark, sf, "part")
    folded = T.fold(F.col("p_name"))
    turned, wrong = F.array_join(F.reverse(F.split(folded, " ")), " "), F.concat(folded, F.lit("s"))
    form = lambda c, tier, score: F.struct(c.alias("form"), F.lit(tier).alias("tier"), F.lit(score).alias("score"))
    terms = part.select("p_name").distinct().select(F.col("p_name").alias("term"), F.array(form(folded, "canonical", 0.95), form(turned, "variant", 0.9), form(wrong, "error", 0.8)).alias("forms"))
    k = F.col("p_partkey") % 4
    return joins.glossary_tiers(part.select(F.col("p_partkey").alias("mention_id"), F.when(k == 0, folded).when(k == 1, turned).when(k == 2, wrong).otherwise("no such").alias("surface")), terms)


@query("cluster_scores", """WITH a AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type)), b AS (SELECT sum(n * (n - 1) / 2) AS g FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)), c AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM part GROUP BY p_type))
SELECT x::BIGINT AS "both", g::BIGINT AS in_gold, p::BIGINT AS in_predicted, round(x / p, 6) AS precision, round(x / g, 6) AS recall, round(2 * (x / p) * (x / g) / (x / p + x / g), 6) AS f1 FROM a, b, c""")
def cluster_scores(spark, sf):
    return joins.cluster_scores(table(spark, sf, "part").select(F.col("p_brand").alias("gold"), F.col("p_type").alias("predicted")))


@query("perf_comparison", """WITH s AS (SELECT event_type AS name, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'base' ELSE 'other' END AS side, CASE WHEN event_type = 'view' AND ts >= TIMESTAMP '2024-01-15 00:00:00' THEN value + 500 ELSE value END AS value FROM events), m AS (SELECT name, side, median(value) AS mid FROM s GROUP BY ALL),
d AS (SELECT name, side, any_value(mid) AS mid, median(abs(value - mid)) AS mad FROM s JOIN m USING (name, side) GROUP BY ALL), r AS (SELECT name, max(mid) FILTER (side = 'base') AS base, max(mid) FILTER (side = 'other') AS other, sum(mad) AS noise FROM d GROUP BY name)
SELECT name, round(base, 6) AS base, round(other, 6) AS other, round(other - base, 6) AS effect, CASE WHEN abs(other - base) <= 3 * noise THEN 'same' WHEN other > base THEN 'slower' ELSE 'faster' END AS verdict FROM r""")
def perf_comparison(spark, sf):
    late = F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.when(late, "other").otherwise("base").alias("side"), F.when(late & (F.col("event_type") == "view"), F.col("value") + 500).otherwise(F.col("value")).alias("value"))
    return joins.compared(rows)


@query("engine_scores", f"""WITH {ENGINE} SELECT predicate, count(*) AS support, count(*) FILTER (first = 'ACCEPT' AND flag = 'A') AS right_accepts, count(*) FILTER (first = 'ACCEPT' AND flag <> 'A') AS false_accepts, count(*) FILTER (first = 'REJECT_INVALID' AND flag = 'A') AS false_rejects,
  round(count(*) FILTER (first <> 'ABSTAIN') / count(*)::DOUBLE, 6) AS coverage FROM d GROUP BY predicate""")
def engine_scores(spark, sf):
    d, good = F.col("decision"), F.col("flag") == "A"
    return judged(spark, sf).groupBy("predicate").agg(
        F.count("*").alias("support"), F.count_if((d == "ACCEPT") & good).alias("right_accepts"), F.count_if((d == "ACCEPT") & ~good).alias("false_accepts"), F.count_if((d == "REJECT_INVALID") & good).alias("false_rejects"),
        F.round(F.count_if(d != "ABSTAIN") / F.count("*"), 6).alias("coverage"),
    )


@query("review_priority", f"""WITH {ENGINE} SELECT claim_id AS id, first AS decision, row_number() OVER (ORDER BY CASE first WHEN 'REVIEW' THEN 0 WHEN 'ABSTAIN' THEN 1 WHEN 'REJECT_INVALID' THEN 2 ELSE 3 END, flag = 'R' DESC, nullif(confidence, 1) ASC NULLS FIRST, claim_id) AS place FROM d""")
def review_priority(spark, sf):
    rows = judged(spark, sf).select(F.col("claim_id").alias("id"), "decision", (F.col("flag") == "R").alias("disagree"), F.nullif(F.col("confidence"), F.lit(1.0)).alias("confidence"))
    return joins.priority(rows, ["REVIEW", "ABSTAIN", "REJECT_INVALID"])


@query("character_error_rates", f"""WITH p AS (SELECT p_partkey, {fold('p_name')} AS a, array_to_string(list_reverse(string_split({fold('p_name')}, ' ')), ' ') AS b FROM part) SELECT p_partkey, round(levenshtein(a, b) / length(a)::DOUBLE, 6) AS cer FROM p""")
def character_error_rates(spark, sf):
    a = T.fold(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", T.error_rate(a, F.array_join(F.reverse(F.split(a, " ")), " ")).alias("cer"))


@query("facet_values", """SELECT facet, value, count(*) AS n FROM (SELECT unnest(['brand', 'type', 'size']) AS facet, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part) GROUP BY ALL""")
def facet_values(spark, sf):
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), c.alias("value")) for n, c in (("brand", F.col("p_brand")), ("type", F.col("p_type")), ("size", F.col("p_size").cast("string")))])
    return table(spark, sf, "part").select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))
