"""Queries on transcripts' quality, gaps, phases, relation signals, policies, gates and families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import cues
from ledgerloom.functions.scores import first_that
from ledgerloom.operators import assess
from ledgerloom.plans.decision_queries import cased
from ledgerloom.plans.extract_queries import MENTIONS, mention_pairs
from ledgerloom.plans.text_queries import fold
from ledgerloom.session import spread
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- transcripts: an order is a transcript, its lines are segments

@query("transcript_quality", r"""WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 > 0 THEN 10.0 + o_custkey % 80 END::DOUBLE AS duration, o_orderpriority LIKE '1%' AS diarized FROM orders),
s AS (SELECT l_orderkey AS id, (l_linenumber * 10 + l_partkey % 5)::DOUBLE AS start, (l_linenumber * 10 + l_partkey % 5 + 2 + l_suppkey % 9)::DOUBLE AS stop, 'So it is. ' || l_returnflag || chr(10) || l_returnflag AS text, l_partkey FROM lineitem),
a AS (SELECT *, start - lag(stop) OVER (PARTITION BY id ORDER BY start, stop) > 3 AS gap FROM s),
m AS (SELECT id, sum(greatest(0, stop - start)) AS covered, arg_max(stop, (start, stop)) AS last, coalesce(bool_or(gap), FALSE) AS gap FROM a GROUP BY id),
p AS (SELECT id, start, stop, i, trim(lower(x)) AS part FROM (SELECT id, start, stop, unnest(regexp_split_to_array(text, '[.\n]')) AS x, generate_subscripts(regexp_split_to_array(text, '[.\n]'), 1) AS i FROM s) WHERE trim(x) <> ''),
l AS (SELECT id, bool_or(coalesce(loop, FALSE)) AS loop FROM (SELECT id, part = lag(part, 1) OVER w AND part = lag(part, 2) OVER w AS loop FROM p WINDOW w AS (PARTITION BY id ORDER BY start, stop, i)) GROUP BY id),
f AS (SELECT t.id, covered, coalesce(covered / duration < 0.8, FALSE) AS low, coalesce(duration - last > greatest(3, duration * 0.05), FALSE) AS tail, coalesce(gap, FALSE) AS gap, coalesce(loop, FALSE) AS loop, diarized FROM t LEFT JOIN m USING (id) LEFT JOIN l USING (id))
SELECT id, CASE WHEN covered IS NULL THEN 0.0 ELSE round(1 - 0.25 * low::INT - 0.25 * tail::INT - 0.1 * gap::INT - 0.25 * loop::INT, 6) END::DOUBLE AS quality,
  CASE WHEN covered IS NULL THEN 'EMPTY_TEXT' ELSE array_to_string(list_sort(list_filter([CASE WHEN low THEN 'LOW_ASR_COVERAGE' END, CASE WHEN tail THEN 'TRUNCATED_TAIL' END, CASE WHEN gap THEN 'TIMELINE_GAP' END, CASE WHEN loop THEN 'REPEATED_CONTENT' END, CASE WHEN NOT diarized THEN 'NO_DIARIZATION' END], lambda x: x IS NOT NULL)), ',') END AS flags FROM f""")
def transcript_quality(spark, sf):
    start, flag = F.col("l_linenumber") * 10 + F.col("l_partkey") % 5, F.col("l_returnflag")
    transcripts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 7 > 0, 10.0 + F.col("o_custkey") % 80).alias("duration"), F.col("o_orderpriority").startswith("1").alias("diarized"))
    segments = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), start.cast("double").alias("start"), (start + 2 + F.col("l_suppkey") % 9).cast("double").alias("end"), F.concat(F.lit("So it is. "), flag, F.lit("\n"), flag).alias("text"))
    return assess.transcript_quality(transcripts, segments).withColumn("flags", F.array_join("flags", ","))


@query("repeated_blocks", """WITH w AS (SELECT doc_id, substring(text, CAST(i AS INTEGER), 24) AS block FROM (SELECT doc_id, text, unnest(range(1, length(text) - 22)) AS i FROM documents)),
r AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM w GROUP BY doc_id, block HAVING count(*) >= 3))
SELECT doc_id, doc_id IN (SELECT doc_id FROM r) AND coalesce(length(text) >= 72, FALSE) AS repeated FROM documents""")
def repeated_blocks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", assess.repeats_block(F.col("text")).alias("repeated"))


def chunks(spark, sf):
    start = F.col("l_linenumber") * 3 + F.col("l_suppkey") % 3
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), start.cast("long").alias("start"), (start + F.col("l_partkey") % 4).cast("long").alias("end"))


GAPS = """WITH c AS (SELECT l_orderkey AS key, l_linenumber * 3 + l_suppkey % 3 AS start, l_linenumber * 3 + l_suppkey % 3 + l_partkey % 4 AS stop FROM lineitem),
g AS (SELECT key, start, lag(stop) OVER (PARTITION BY key ORDER BY start, stop) + {0} AS gap_start FROM c)
SELECT key, gap_start, start - {0} AS gap_end, start - gap_start AS missing FROM g WHERE start > gap_start"""


@query("page_gaps", GAPS.format(1))
def page_gaps(spark, sf):
    return assess.range_gaps(chunks(spark, sf), 1)


@query("offset_gaps", GAPS.format(0))
def offset_gaps(spark, sf):
    return assess.range_gaps(chunks(spark, sf), 0)


# The words that begin a new phase.
TURNS = "ya no|dejo de|dejaron de|mas tarde|despues|luego|posteriormente|con el tiempo|hasta que|ahora|actualmente|hoy"
TURNS_SQL = TURNS.replace("dejo", "dej[oó]").replace("mas", "m[aá]s").replace("despues", "despu[eé]s")
STORY = "p_brand || ' fue aliado' || CASE p_size % 4 WHEN 0 THEN ', luego rival; ' WHEN 1 THEN ' y dejó de vivir en ' WHEN 2 THEN '. Ahora reside en ' ELSE ' de ' END || p_type || CASE WHEN p_size % 3 = 0 THEN ' hasta que después vuelve.' ELSE '' END"


@query("transition_phases", f"""WITH s AS (SELECT p_partkey, {STORY} AS text FROM part), c AS (SELECT p_partkey, string_split(regexp_replace(text, '(^|[^\\p{{L}}\\p{{N}}_])({TURNS_SQL})\\b', '\\1' || chr(1) || '\\2', 'gi'), chr(1)) AS parts FROM s),
p AS (SELECT p_partkey, list_filter(list_transform(parts, lambda x: trim(x, ' ,.;:-')), lambda x: x <> '') AS parts FROM c),
u AS (SELECT p_partkey, unnest(parts) AS phase, generate_subscripts(parts, 1) - 1 AS place FROM p), t AS (SELECT *, {fold('phase')} AS t FROM u)
SELECT p_partkey, place, phase, {cased(cues.TEMPORAL, 'UNKNOWN')} AS state FROM t""")
def transition_phases(spark, sf):
    stories = spread(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type")).select("p_partkey", F.expr(STORY).alias("text"))
    return assess.phases(stories, TURNS, ["p_partkey"]).withColumn("place", F.col("place").cast("long")).withColumn("state", cues.temporal_state(F.col("phase")))


# ---- relations

VERBS = ["the", "and", "of", "die", "der", "que"]
LIST = "[" + ", ".join(f"'{v}'" for v in VERBS) + "]"


@query("relation_signals", rf"""WITH RECURSIVE {MENTIONS}, m AS (SELECT doc_id, start AS s, stop AS se, lead(start) OVER w AS o, lead(stop) OVER w AS oe FROM mentions WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
p AS (SELECT m.*, text FROM m JOIN documents USING (doc_id) WHERE o IS NOT NULL),
b AS (SELECT *, substring(text, se + 1, o - se) AS mid, substring(text, s + 1, o - s) AS upto, regexp_extract_all(lower(substring(text, se + 1, o - se)), '\p{{L}}+') AS words FROM p)
SELECT doc_id, s AS s_start, o - se AS chars, NOT regexp_matches(upto, '[.!?\n]') AS same_sentence, NOT regexp_matches(upto, '[.!?\n,;:]') AS same_clause, list_filter({LIST}, lambda v: list_contains(words, v))[1] AS verb FROM b""")
def relation_signals(spark, sf):
    """Each mention of a document and the next one."""
    rows = assess.pair_signals(mention_pairs(spark, sf), VERBS)
    return rows.select("doc_id", (F.col("at") + F.col("s_start")).alias("s_start"), "chars", "same_sentence", "same_clause", "verb")


def sql_cue(cues_):
    """The first cue of a list in a window w of lower-case l, as it stands there."""
    each = ", ".join(f"{{pos: instr(l, '{c}'), k: {k}, n: {len(c)}}}" for k, c in enumerate(cues_))
    return f"(SELECT substring(w, CAST(x.pos AS INTEGER), x.n) FROM (SELECT list_sort(list_filter([{each}], lambda x: x.pos > 0))[1] AS x))"


TYPES = " ".join(f"WHEN (st, ot) IN ({', '.join(str(k) for k in kinds)}) THEN '{name}'" for name, kinds in assess.TYPE_PAIRS.items())


@query("relation_cues", rf"""WITH RECURSIVE {MENTIONS}, m AS (SELECT doc_id, start AS s, stop AS se, type AS st, lead(start) OVER w AS o, lead(stop) OVER w AS oe, lead(type) OVER w AS ot FROM mentions WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
p AS (SELECT m.*, text, length(regexp_extract(substring(text, 1, s), '(?s)^.*[.!?\n]')) AS lo, oe + length(regexp_extract(substring(text, oe + 1), '(?s)^[^.!?\n]*[.!?\n]?')) AS hi FROM m JOIN documents USING (doc_id) WHERE o IS NOT NULL),
q AS (SELECT *, substring(text, CAST(lo + 1 AS INTEGER), CAST(hi - lo AS INTEGER)) AS w, lower(substring(text, CAST(lo + 1 AS INTEGER), CAST(hi - lo AS INTEGER))) AS l FROM p)
SELECT doc_id, s AS s_start, {", ".join(f"{sql_cue(c)} AS {name}" for name, c in assess.SENTENCE_CUES.items())},
  array_to_string(list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN instr(l, '{c}') > 0 THEN substring(w, CAST(instr(l, '{c}') AS INTEGER), {len(c)}) END" for c in assess.TIME_CUES)}], lambda x: x IS NOT NULL))), ',') AS times,
  coalesce(CASE {TYPES} END, '') AS categories FROM q""")
def relation_cues(spark, sf):
    rows = assess.cue_signals(assess.pair_window(mention_pairs(spark, sf)))
    return rows.select("doc_id", (F.col("at") + F.col("s_start")).alias("s_start"), *assess.SENTENCE_CUES, F.array_join("times", ",").alias("times"), F.array_join("categories", ",").alias("categories"))


@query("relation_directions", """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 5 AS k, CASE l_partkey % 5 WHEN 0 THEN ' was founded by ' WHEN 1 THEN ' is led from ' WHEN 2 THEN ' leads ' WHEN 3 THEN ' bypasses ' ELSE ' and ' END AS between FROM lineitem),
w AS (SELECT *, CASE WHEN k = 0 THEN 'symmetric' WHEN k = 1 THEN 'generic' WHEN between = ' was founded by ' THEN 'passive_agent' WHEN contains(between, 'is led') THEN 'lexical_inverse' WHEN contains(between, 'leads') THEN 'lexical_active' ELSE 'textual_order' END AS why FROM r)
SELECT l_orderkey, l_linenumber, why, CASE WHEN why IN ('symmetric', 'generic') THEN 'undirected' WHEN why IN ('passive_agent', 'lexical_inverse') THEN 'object_to_subject' ELSE 'subject_to_object' END AS direction FROM w""")
def relation_directions(spark, sf):
    k, p = F.col("l_suppkey") % 5, F.col("l_partkey") % 5
    between = first_that((p == 0, " was founded by "), (p == 1, " is led from "), (p == 2, " leads "), (p == 3, " bypasses "), otherwise=" and ")
    way, why = assess.direction(k != 1, k == 0, between, "by", F.lit("leads"), F.lit("is led"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", why.alias("why"), way.alias("direction"))


RULES = [("LEADS", "power", "A", "F", ["leads", "rules"], 1.0, 0.3), ("OWNS", "property", "A", "F", ["owns", "rules"], 1.0, 0.25), ("SERVES", "power", "R", "F", ["serves"], 1.0, 0.0), ("LIVES_IN", "place", "N", "O", ["lives"], 1.0, 0.2)]
WINDOW = "CASE l_suppkey % 5 WHEN 0 THEN 'He leads them' WHEN 1 THEN 'She rules it' WHEN 2 THEN 'He serves and owns' WHEN 3 THEN 'It lives' ELSE 'nothing' END"


@query("relation_predicates", f"""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS pair_id, l_returnflag AS a, l_linestatus AS b, lower({WINDOW}) AS t FROM lineitem),
r(predicate, family, a, b, phrases, prior) AS (VALUES {", ".join(f"('{p}', '{f}', '{a}', '{b}', {list(w)}, {y})" for p, f, a, b, w, _, y in RULES)}),
s AS (SELECT pair_id, predicate, family, len(list_filter(phrases, lambda x: contains(t, x))) AS hits, round(len(list_filter(phrases, lambda x: contains(t, x))) + prior, 6)::DOUBLE AS score FROM p JOIN r USING (a, b)),
k AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS ns, lead(hits) OVER w AS nh, lead(family) OVER w AS nf FROM s WHERE score > 0 WINDOW w AS (PARTITION BY pair_id ORDER BY score DESC, hits DESC, predicate)),
c AS (SELECT pair_id, predicate, CASE WHEN hits = 0 THEN 'prior_only' WHEN nh > 0 AND nf <> family AND round(score - ns, 6) < 0.1 THEN 'confusable' ELSE 'lexical' END AS why FROM k WHERE rk = 1)
SELECT pair_id, coalesce(predicate, 'RELATED_TO') AS predicate, coalesce(why IN ('prior_only', 'confusable'), FALSE) AS abstained, coalesce(why, 'fallback') AS why FROM p LEFT JOIN c USING (pair_id)""")
def relation_predicates(spark, sf):
    pairs = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"), F.col("l_returnflag").alias("s_type"), F.col("l_linestatus").alias("o_type"), F.expr(WINDOW).alias("window"))
    rules = spark.createDataFrame(RULES, "predicate string, family string, s_type string, o_type string, phrases array<string>, weight double, prior double")
    return assess.choose_predicates(pairs, rules, 0.1)


TERMS = [("VIEW", "VIEW", "canonical"), ("LOGIN", "VIEW", "alias"), ("PURCHASE_NOW", "PURCHASE", "alias"), ("PURCHASE", "PURCHASE", "canonical"), ("ERROR", None, "out_of_vocab")]
RAW = "CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN ' ' || upper(event_type) || '!' ELSE event_type || '--now' END"


@query("predicate_vocabulary", f"""WITH e AS (SELECT event_id, {RAW} AS raw FROM events), v(term, canonical, status) AS (VALUES {", ".join(f"('{t}', {'NULL' if c is None else repr(c)}, '{s}')" for t, c, s in TERMS)}),
n AS (SELECT *, trim(regexp_replace(upper(raw), '[^A-Z0-9]+', '_', 'g'), '_') AS term FROM e)
SELECT raw, canonical, coalesce(status, 'unknown') AS status, coalesce(status, 'unknown') IN ('out_of_vocab', 'unknown') AS needs_human, count(*) AS n FROM n LEFT JOIN v USING (term) GROUP BY ALL""")
def predicate_vocabulary(spark, sf):
    raw = table(spark, sf, "events").select(F.expr(RAW).alias("raw"))
    return assess.canonical_predicates(raw, spark.createDataFrame(TERMS, "term string, canonical string, status string")).groupBy("raw", "canonical", "status", "needs_human").agg(F.count("*").alias("n"))


@query("relation_abstentions", """WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey % 6 = 0 AS pred, l_suppkey % 5 = 0 AS dir, l_discount > 0.08 AS ended, l_tax > 0.07 AS unsaid, l_returnflag = 'R' AS negated, CASE WHEN l_linestatus = 'F' THEN l_quantity > 45 END AS types FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN (ended OR negated) AND NOT pred THEN 'REJECT' WHEN ended OR negated OR pred OR dir OR coalesce(types, FALSE) THEN 'ABSTAIN' ELSE 'NEUTRAL' END AS verdict,
  array_to_string(list_sort(list_filter([CASE WHEN pred THEN 'PREDICATE_ABSTAINED' END, CASE WHEN dir THEN 'DIRECTION_LOW_CONFIDENCE' END, CASE WHEN ended THEN 'TEMPORAL_ENDED' END, CASE WHEN unsaid THEN 'EPISTEMIC_NOT_ASSERTED' END, CASE WHEN negated THEN 'NEGATED_RELATION' END, CASE WHEN types THEN 'TYPE_INCOMPATIBLE' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM f""")
def relation_abstentions(spark, sf):
    k = F.col("l_suppkey")
    verdict, reasons = assess.abstention({
        "PREDICATE_ABSTAINED": ("blocking", k % 6 == 0), "DIRECTION_LOW_CONFIDENCE": ("blocking", k % 5 == 0), "TEMPORAL_ENDED": ("rejecting", F.col("l_discount") > 0.08),
        "EPISTEMIC_NOT_ASSERTED": ("informative", F.col("l_tax") > 0.07), "NEGATED_RELATION": ("rejecting", F.col("l_returnflag") == "R"), "TYPE_INCOMPATIBLE": ("blocking", F.when(F.col("l_linestatus") == "F", F.col("l_quantity") > 45)),
    }, "PREDICATE_ABSTAINED")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", verdict.alias("verdict"), F.array_join(reasons, ",").alias("reasons"))


@query("relation_review_labels", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_discount >= 0.05 AND l_suppkey % 3 >= 1 AND l_quantity > 5 AND l_partkey % 4 = 0 THEN 'AUTO_PROPOSABLE' ELSE 'HUMAN_REQUIRED' END AS label FROM lineitem""")
def relation_review_labels(spark, sf):
    state = first_that((F.col("l_returnflag") == "N", "STRONG_CONSENSUS"), (F.col("l_returnflag") == "R", "PARTIAL_CONSENSUS"), otherwise=None)
    evidence = F.when(F.col("l_quantity") > 5, True)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", assess.review_label(state, F.col("l_discount"), F.col("l_suppkey") % 3, evidence, F.col("l_partkey") % 4, 0.05).alias("label"))


# ---- runs

CALLS = """c AS (SELECT user_id % 4 AS provider, CASE WHEN event_type = 'error' AND value > 50 THEN 'transport_error: reset' WHEN event_type = 'error' THEN 'parse: no object' WHEN event_type = 'signup' THEN 'timeout' END AS marker,
  CASE WHEN event_type = 'view' THEN 'invalid_candidate' WHEN event_type = 'click' AND value > 100 THEN 'invalid_response' END AS reason, CASE WHEN value > 20 THEN value END AS seconds FROM events)"""
RATES = f"""{CALLS}, o AS (SELECT provider, CASE WHEN marker LIKE 'transport_error:%' OR marker = 'timeout' THEN 'transport' WHEN reason = 'invalid_candidate' THEN 'indeterminate' WHEN marker IS NOT NULL OR reason = 'invalid_response' OR seconds > 0 THEN 'responded' ELSE 'indeterminate' END AS outcome FROM c),
r AS (SELECT provider, count(*) AS attempted, count(*) FILTER (outcome = 'responded') AS responded, count(*) FILTER (outcome = 'transport') AS errors, count(*) FILTER (outcome = 'indeterminate') AS indeterminate FROM o GROUP BY provider)"""


def rates(spark, sf):
    kind, v = F.col("event_type"), F.col("value")
    marker = first_that(((kind == "error") & (v > 50), "transport_error: reset"), (kind == "error", "parse: no object"), (kind == "signup", "timeout"), otherwise=None)
    reason = first_that((kind == "view", "invalid_candidate"), ((kind == "click") & (v > 100), "invalid_response"), otherwise=None)
    calls = table(spark, sf, "events").select((F.col("user_id") % 4).alias("provider"), assess.provider_outcome(marker, reason, F.when(v > 20, v)).alias("outcome"))
    return assess.outcome_rates(calls, "provider")


@query("provider_outcomes", f"WITH {RATES} SELECT *, round(errors / attempted::DOUBLE, 4) AS rate FROM r")
def provider_outcomes(spark, sf):
    return rates(spark, sf)


@query("run_verdicts", f"""WITH {RATES}, m AS (SELECT provider, 'answered' AS name, CASE WHEN provider <> 3 THEN responded / attempted::DOUBLE END AS value FROM r UNION ALL SELECT provider, 'clean', 1 - errors / attempted::DOUBLE FROM r),
g AS (SELECT *, CASE WHEN value IS NULL THEN 'NOT_MEASURED' WHEN value >= 0.6 THEN 'PASS' WHEN value >= 0.45 THEN 'PARTIAL' ELSE 'FAIL' END AS gate FROM m)
SELECT provider, CASE WHEN bool_or(gate = 'NOT_MEASURED' AND name = 'answered') THEN 'NO_VERDICT' WHEN bool_or(gate = 'FAIL' AND name = 'answered') THEN 'NOT_FIT' WHEN count(*) FILTER (gate = 'FAIL') > 0 THEN 'FIT_WITH_RESERVES' ELSE 'FIT' END AS verdict, count(*) FILTER (gate = 'FAIL') AS failed FROM g GROUP BY provider""")
def run_verdicts(spark, sf):
    share = lambda c: F.col(c).cast("double") / F.col("attempted")
    metrics = F.array(F.struct(F.lit("answered").alias("name"), F.when(F.col("provider") != 3, share("responded")).alias("value")), F.struct(F.lit("clean").alias("name"), (1 - share("errors")).alias("value")))
    rows = rates(spark, sf).select("provider", F.inline(metrics))
    return assess.run_verdict(assess.gated(rows, 0.6, 0.45), "provider", ["answered"])


@query("negation_policy", """WITH g AS (SELECT doc_id AS case_id, CASE WHEN quality = 0 THEN 'NEGATED_CESSATION' ELSE 'PLAIN' END AS family, CASE WHEN toxic = 0 THEN quality = 0 END AS negated, CASE WHEN toxic = 0 THEN 'AUTO_APPROVE' ELSE 'REVIEW' END AS decision FROM labels),
p AS (SELECT doc_id AS case_id, CASE WHEN lang <> 'de' THEN contains(text, '!!') END AS said, CASE WHEN lang <> 'de' THEN CASE WHEN contains(text, '$$$') THEN 'CESSATION' ELSE '' END END AS kind, CASE WHEN lang = 'en' THEN 'ACCEPT' WHEN lang <> 'de' THEN 'REVIEW' END AS choice, CASE WHEN lang <> 'de' THEN length(text) > 200 END AS anchored, CASE WHEN lang <> 'de' THEN source IS NOT NULL END AS scoped FROM documents),
j AS (SELECT g.*, said IS NULL AS gone, coalesce(said, FALSE) AS said, kind, choice, coalesce(anchored, FALSE) AS anchored, coalesce(scoped, FALSE) AS scoped FROM g LEFT JOIN p USING (case_id) WHERE negated IS NOT NULL),
c AS (SELECT count(*) AS cases, count(*) FILTER (gone) AS missing, count(*) FILTER (negated AND said) AS tp, count(*) FILTER (NOT negated AND said) AS fp, count(*) FILTER (negated AND NOT said) AS fn, count(*) FILTER (family = 'NEGATED_CESSATION') AS cessations, count(*) FILTER (family = 'NEGATED_CESSATION' AND kind = 'CESSATION') AS false_cessations,
  count(*) FILTER (anchored) AS anchored, count(*) FILTER (scoped) AS scoped, count(*) FILTER (negated AND decision = 'AUTO_APPROVE') AS approvable, count(*) FILTER (negated AND decision = 'AUTO_APPROVE' AND choice = 'ACCEPT') AS approved FROM j)
SELECT *, fp = 0 AND fn = 0 AS edges_pass, false_cessations = 0 AS cessation_pass, cases > 0 AND anchored = cases AS grounding_pass, cases > 0 AND scoped = cases AS scope_pass, approvable > 0 AND approved = approvable AS approval_pass FROM c""")
def negation_policy(spark, sf):
    """Annotations of toxic texts are open; the judge of the predictions knows no German, whose cases count as missing."""
    bad = F.col("quality") == 0
    gold = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.when(bad, "NEGATED_CESSATION").otherwise("PLAIN").alias("family"), F.when(F.col("toxic") == 0, bad).alias("negated"), F.when(F.col("toxic") == 0, "AUTO_APPROVE").otherwise("REVIEW").alias("decision"))
    has = lambda x: F.contains("text", F.lit(x))
    known = lambda c: F.when(F.col("lang") != "de", c)
    predicted = table(spark, sf, "documents").select(
        F.col("doc_id").alias("case_id"), known(has("!!")).alias("negated_p"), known(F.when(has("$$$"), "CESSATION").otherwise("")).alias("kind"), known(F.when(F.col("lang") == "en", "ACCEPT").otherwise("REVIEW")).alias("decision_p"),
        known(F.length("text") > 200).alias("anchored"), known(F.col("source").isNotNull()).alias("scoped"),
    )
    return assess.negation_metrics(gold, predicted)


FAMILIES = [(1, "F", "p1", None, "first"), (2, "F", None, "n2", "second"), (3, "F", None, None, "rest"), (4, "O", None, "n1", "other")]


@query("independence_families", f"""WITH o AS (SELECT l_linestatus AS step, 'p' || l_suppkey % 3 AS provider, 'n' || l_partkey % 4 AS name FROM lineitem)
SELECT step, provider, name, CASE {" ".join(f"WHEN step = '{s}'" + (f" AND provider = '{p}'" if p else "") + (f" AND name = '{n}'" if n else "") + f" THEN '{f}'" for _, s, p, n, f in FAMILIES)} ELSE 'unclassified' END AS family, count(*) AS n FROM o GROUP BY ALL""")
def independence_families(spark, sf):
    origins = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("origin_id"), F.col("l_linestatus").alias("step"), F.concat(F.lit("p"), F.col("l_suppkey") % 3).alias("provider"), F.concat(F.lit("n"), F.col("l_partkey") % 4).alias("name"))
    # Few kinds of origins come in many rows: families are found a kind, not a row.
    kinds = origins.groupBy("step", "provider", "name").agg(F.count("*").alias("n")).withColumn("origin_id", F.struct("step", "provider", "name"))
    rules = spark.createDataFrame(FAMILIES, "priority int, step string, provider string, name string, family string")
    return assess.families(kinds, rules).join(kinds, "origin_id").select("step", "provider", "name", "family", "n")
