"""Queries on mentions and claims found in texts.

The lexicon is drawn from the benchmark table: the first three words of an item are a thing's name, later pairs of words
and long words its aliases. Function words that are frequent in the documents' four languages stand for phrases of relations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.negation import readings
from ledgerloom.operators import lexicon
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


RULES = [
    ("R1", "LINKS", "SUBJECT_TO_OBJECT", 0.75, ["is", "was", "ist", "es"], [], ["Faction"], ["that", "it"]), ("R2", "WITHIN", "SUBJECT_TO_OBJECT", 0.72, ["in the", "in", "en la", "en"], [], ["Location", "Faction"], []),
    ("R3", "MADE_BY", "OBJECT_TO_SUBJECT", 0.5, ["by", "par", "von"], ["Location"], [], ["the"]), ("R4", "ALLY_OF", "UNDIRECTED", 0.7, ["with", "avec", "mit", "con"], [], [], []),
]
RULE_COLUMNS = "rule_id string, predicate string, direction string, confidence double, phrases array<string>, subject_types array<string>, object_types array<string>, blocked_before array<string>"
WORD = r"[\p{L}\p{N}_]+"


def rules(spark):
    return spark.createDataFrame(RULES, RULE_COLUMNS)


def entities(spark, sf):
    w = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    items = table(spark, sf, "benchmark").select("item_id", w.alias("w")).filter(F.size("w") >= 3)
    pairs = F.filter(F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.size("w") - 1)), lambda i: F.array_join(F.slice("w", i, 2), " ")), lambda p: F.length(p) >= 8)
    long = F.filter("w", lambda x: F.length(x) >= 7)
    return items.select(
        F.concat(F.lit("item-"), "item_id").alias("entry"), F.array_join(F.slice("w", 1, 3), " ").alias("name"), F.concat(pairs, long).alias("aliases"),
        F.when(F.col("item_id") % 3 == 0, "Faction").when(F.col("item_id") % 3 == 1, "Location").alias("type"), (0.9 - F.col("item_id") % 4 / 10).alias("confidence"),
    )


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")


def hits(spark, sf, paired=False):
    return lexicon.phrase_hits(documents(spark, sf), lexicon.entity_lexicon(entities(spark, sf)).unionByName(lexicon.rule_lexicon(rules(spark))), paired)


def mention_pairs(spark, sf):
    """Each mention of a document and the next one, in the text of their sentences and all between."""
    return lexicon.mention_pairs(documents(spark, sf), lexicon.entity_lexicon(entities(spark, sf))).withColumnRenamed("text_id", "doc_id")


# ---- the same in DuckDB: tokens with places, every run of one to three tokens against the lexicon, overlaps one by one

def array(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


TOKENS = r"""pieces AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[.!?;\n\r]+|[^\p{L}\p{N}_.!?;\n\r]') AS l FROM documents)),
placed AS (SELECT *, regexp_matches(p, '^[\p{L}\p{N}_]') AS word, coalesce(sum(length(p)) OVER b, 0)::INT AS start, coalesce(count(*) FILTER (regexp_matches(p, '^[.!?;\n\r]')) OVER b, 0)::INT AS sentence,
  coalesce(count(*) FILTER (regexp_matches(p, '^[\p{L}\p{N}_]')) OVER b, 0)::INT AS tok FROM pieces WINDOW b AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tok AS (SELECT doc_id, tok, start, start + length(p) AS stop, sentence, strip_accents(lower(p)) AS norm FROM placed WHERE word),
runs AS (SELECT doc_id, tok AS first, tok AS last, start, stop, sentence, sentence AS last_sentence, norm AS key FROM tok
  UNION ALL SELECT a.doc_id, a.tok, b.tok, a.start, b.stop, a.sentence, b.sentence, a.norm || ' ' || b.norm FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.tok = a.tok + 1
  UNION ALL SELECT a.doc_id, a.tok, c.tok, a.start, c.stop, a.sentence, c.sentence, a.norm || ' ' || b.norm || ' ' || c.norm FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.tok = a.tok + 1 JOIN tok c ON c.doc_id = a.doc_id AND c.tok = a.tok + 2)"""
LEXICON = r"""items AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark),
surfaces AS (SELECT DISTINCT item_id, unnest(list_concat([array_to_string(w[1:3], ' ')], list_filter(list_transform(range(4, greatest(4, len(w) - 1) + 1), lambda i: array_to_string(w[i:i + 1], ' ')), lambda p: length(p) >= 8), list_filter(w, lambda x: length(x) >= 7))) AS surface, array_to_string(w[1:3], ' ') AS name FROM items WHERE len(w) >= 3),
entities AS (SELECT 'item-' || item_id AS entry, surface, strip_accents(lower(surface)) AS key, CASE item_id % 3 WHEN 0 THEN 'Faction' WHEN 1 THEN 'Location' END AS type,
  (0.9 - item_id % 4 / 10.0::DOUBLE) * CASE WHEN lower(surface) = lower(name) THEN 1.0 ELSE 0.85::DOUBLE END AS confidence, lower(surface) = lower(name) AS canonical FROM surfaces)"""
MENTIONS = f"""{TOKENS}, {LEXICON},
found AS (SELECT doc_id, first, last, start, stop, sentence, last_sentence, arg_min(e, (e.entry, e.surface)) AS e FROM runs JOIN entities e USING (key) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first - last, first) AS rn FROM found),
taken AS (SELECT doc_id, rn, TRUE AS kept, range(first, last + 1) AS used FROM ranked WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.rn, NOT list_has_any(t.used, range(r.first, r.last + 1)), CASE WHEN list_has_any(t.used, range(r.first, r.last + 1)) THEN t.used ELSE list_concat(t.used, range(r.first, r.last + 1)) END FROM taken t JOIN ranked r ON r.doc_id = t.doc_id AND r.rn = t.rn + 1),
mentions AS (SELECT r.doc_id, r.first, r.last, r.start, r.stop, r.sentence, r.last_sentence, r.e.entry AS entry, r.e.type AS type, r.e.confidence AS confidence, r.e.canonical AS canonical FROM ranked r JOIN taken t ON t.doc_id = r.doc_id AND t.rn = r.rn AND t.kept)"""
RULE_ROWS = "rules(rule_id, predicate, direction, confidence, phrases, subject_types, object_types, blocked) AS (VALUES " + ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', {r[3]}::DOUBLE, {array(r[4])}, {array(r[5])}, {array(r[6])}, {array(r[7])})" for r in RULES) + ")"
JOINT = f"joint AS (SELECT doc_id, first, last, first < last AS wide FROM runs WHERE sentence = last_sentence AND key IN ({', '.join(repr(c) for c in lexicon.COORDINATION)}))"


@query("lexicon_mentions", f"WITH RECURSIVE {MENTIONS} SELECT doc_id, entry, type, round(confidence, 6) AS confidence, canonical, start, stop FROM mentions")
def lexicon_mentions(spark, sf):
    return hits(spark, sf).filter("kind = 'entity'").select(F.col("text_id").alias("doc_id"), "entry", "type", F.round("confidence", 6).alias("confidence"), "canonical", "start", F.col("end").alias("stop"))


@query("rule_claims", rf"""WITH RECURSIVE {MENTIONS}, {RULE_ROWS}, {JOINT},
weak AS (SELECT doc_id, tok AS at FROM placed WHERE p IN (',', ';', ':', '(', ')', '—', '–')),
said AS (SELECT r.doc_id, r.first, r.last, r.start, r.stop, r.sentence, u.* FROM runs r JOIN (SELECT *, unnest(phrases) AS key FROM rules) u USING (key)
  WHERE NOT EXISTS (SELECT 1 FROM tok b WHERE b.doc_id = r.doc_id AND b.tok = r.first - 1 AND list_contains(u.blocked, b.norm))),
sides AS (SELECT p.doc_id, p.rule_id, p.first, p.last, any_value(p) AS p, arg_max(m, m.last) FILTER (m.last < p.first) AS s, arg_min(m, m.first) FILTER (m.first > p.last) AS o, count(*) FILTER (m.last < p.first) AS n_before, count(*) FILTER (m.first > p.last) AS n_after
  FROM said p JOIN mentions m ON m.doc_id = p.doc_id AND m.sentence = p.sentence AND m.last_sentence = p.sentence GROUP BY p.doc_id, p.rule_id, p.first, p.last),
c AS (SELECT * FROM sides WHERE s IS NOT NULL AND o IS NOT NULL),
checked AS (SELECT c.*,
  EXISTS (SELECT 1 FROM joint j WHERE j.doc_id = c.doc_id AND (j.first + j.wide::INT > s.last AND j.last - j.wide::INT < c.first OR n_before > 1 AND j.first + j.wide::INT >= s.first - 4 AND j.last - j.wide::INT < s.first)
    AND EXISTS (SELECT 1 FROM tok t WHERE t.doc_id = j.doc_id AND t.tok = j.first AND t.sentence = p.sentence)) AS joint_s,
  EXISTS (SELECT 1 FROM joint j WHERE j.doc_id = c.doc_id AND (j.first + j.wide::INT > c.last AND j.last - j.wide::INT < o.first OR n_after > 1 AND j.last - j.wide::INT <= o.last + 4 AND j.first + j.wide::INT > o.last)
    AND EXISTS (SELECT 1 FROM tok t WHERE t.doc_id = j.doc_id AND t.tok = j.first AND t.sentence = p.sentence)) AS joint_o,
  EXISTS (SELECT 1 FROM weak w WHERE w.doc_id = c.doc_id AND (w.at > s.last AND w.at <= c.first OR w.at > c.last AND w.at <= o.first)) AS weak,
  EXISTS (SELECT 1 FROM tok t WHERE t.doc_id = c.doc_id AND t.tok = s.first - 1 AND t.sentence = s.sentence AND t.norm IN ('de', 'del', 'por', 'para', 'segun', 'sobre')) AS mod_s,
  EXISTS (SELECT 1 FROM tok t WHERE t.doc_id = c.doc_id AND t.tok = o.first - 1 AND t.tok > c.last AND t.norm IN ('de', 'del', 'por', 'para', 'segun', 'sobre')) AS mod_o FROM c),
r AS (SELECT *, list_sort(list_filter([
  CASE WHEN p.first - s.last - 1 > 2 OR o.first - p.last - 1 > 2 THEN 'ARGUMENT_TOO_FAR' END, CASE WHEN joint_s THEN 'COORDINATED_SUBJECT' END, CASE WHEN joint_o THEN 'COORDINATED_OBJECT' END, CASE WHEN mod_s THEN 'SUBJECT_IS_MODIFIER' END,
  CASE WHEN mod_o THEN 'OBJECT_IS_MODIFIER' END, CASE WHEN n_before > 1 THEN 'MULTIPLE_SUBJECT_CANDIDATES' END, CASE WHEN weak THEN 'PUNCTUATION_BETWEEN_ARGUMENTS' END,
  CASE WHEN o.type IS NOT NULL AND len(p.object_types) > 0 AND NOT list_contains(p.object_types, o.type) THEN 'OBJECT_TYPE_MISMATCH' END,
  CASE WHEN s.type IS NOT NULL AND len(p.subject_types) > 0 AND NOT list_contains(p.subject_types, s.type) THEN 'SUBJECT_TYPE_MISMATCH' END], lambda x: x IS NOT NULL)) AS reasons,
  least(0.9, round(p.confidence * least(s.confidence, o.confidence) / 0.9, 4))::DOUBLE AS sure FROM checked)
SELECT doc_id, rule_id, p.predicate AS predicate, p.direction AS direction, p.start AS start, p.stop AS stop, s.entry AS subject, s.start AS s_start, s.stop AS s_end, o.entry AS object, o.start AS o_start, o.stop AS o_end,
  array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN sure END AS confidence, CASE WHEN len(reasons) = 0 THEN sure < 0.6 END AS review FROM r""")
def rule_claims(spark, sf):
    found = lexicon.rule_claims(hits(spark, sf, paired=True), rules(spark))
    return found.drop("copy", "sentence").withColumnsRenamed({"text_id": "doc_id", "end": "stop"}).withColumn("reasons", F.array_join("reasons", ","))


# ---- what sentences say of a thing

# Templates of sentences around a thing's name, and how each is to be read: negated, kind, hint, factivity, action.
SENTENCES = [
    ("{} lidera la orden", False, "", "ASSERTED", "ASSERTED_FACT", "EMIT_WORLD_CLAIM"), ("{} no lidera la orden", True, "SIMPLE", "ASSERTED", "NEGATED_FACT", "EMIT_NEGATED_WORLD_CLAIM"),
    ("{} nunca lidera la orden", True, "NEVER", "ASSERTED", "NEGATED_FACT", "EMIT_NEGATED_WORLD_CLAIM"), ("{} ya no lidera la orden", True, "CESSATION", "ASSERTED", "NEGATED_FACT", "EMIT_NEGATED_WORLD_CLAIM"),
    ("{} todavía no lidera la orden", True, "NOT_YET", "ASSERTED", "NEGATED_FACT", "EMIT_NEGATED_WORLD_CLAIM"), ("{} no cree que lidera la orden", False, "SCOPE_AMBIGUOUS", "ASSERTED", "UNKNOWN", "REVIEW_SCOPE"),
    ("{} no llega, pero lidera la orden", False, "", "ASSERTED", "NEGATED_FACT", "EMIT_NEGATED_WORLD_CLAIM"), ("Se dice que {} lidera la orden", False, "", "RUMORED", "RUMOR", "EMIT_EPISTEMIC_PROPOSAL"),
    ("Si {} lidera la orden, bien", False, "", "HYPOTHETICAL", "CONDITIONAL", "EMIT_DIAGNOSTIC"), ("¿{} lidera la orden", False, "", "UNKNOWN", "QUESTION", "EMIT_DIAGNOSTIC"),
    ("Es falso que {} lidera la orden", False, "", "UNKNOWN", "REPORTED_FALSEHOOD", "EMIT_DIAGNOSTIC"), ("En la farsa {} lidera la orden", False, "", "UNKNOWN", "FICTION_WITHIN_FICTION", "EMIT_DIAGNOSTIC"),
    ("Ojalá {} lidera la orden", False, "", "UNKNOWN", "DESIRE", "EMIT_DIAGNOSTIC"), ("{} vino sin que nadie lidera la orden", True, "SIMPLE", "ASSERTED", "NEGATED_FACT", "EMIT_NEGATED_WORLD_CLAIM"),
    ("El heraldo dijo que {} lidera la orden", False, "", "RUMORED", "RUMOR", "EMIT_EPISTEMIC_PROPOSAL"), ("La cuenta que {} lidera la orden", False, "", "ASSERTED", "ASSERTED_FACT", "EMIT_WORLD_CLAIM"),
    ("Quizás {} lidera la orden", False, "", "HYPOTHETICAL", "HYPOTHETICAL", "EMIT_DIAGNOSTIC"), ("{} lidera la orden y no abandona el puesto", False, "SCOPE_AMBIGUOUS", "ASSERTED", "UNKNOWN", "REVIEW_SCOPE"),
    ("De haber ido, {} lidera la orden", False, "", "HYPOTHETICAL", "COUNTERFACTUAL", "EMIT_DIAGNOSTIC"), ("{} no pocas veces lidera la orden", False, "", "ASSERTED", "ASSERTED_FACT", "EMIT_WORLD_CLAIM"),
    ("{} ha dejado de fumar y lidera la orden", False, "", "ASSERTED", "ASSERTED_FACT", "EMIT_WORLD_CLAIM"), ("{} tampoco lidera la orden", True, "SIMPLE", "ASSERTED", "NEGATED_FACT", "EMIT_NEGATED_WORLD_CLAIM"),
]


@query("sentence_readings", "WITH t(k, negated, kind, hint, factivity, action) AS (VALUES " + ", ".join(f"({k}, {str(n).upper()}, '{a}', '{b}', '{c}', '{d}')" for k, (_, n, a, b, c, d) in enumerate(SENTENCES)) + f""")
SELECT p_partkey, negated, kind, hint, factivity, action FROM part JOIN t ON t.k = p_partkey % {len(SENTENCES)}""")
def sentence_readings(spark, sf):
    name = F.concat(F.lit("el señor "), F.col("p_brand"))
    said = F.element_at(F.array(*[F.replace(F.lit(s[0]), F.lit("{}"), name) for s in SENTENCES]), (F.col("p_partkey") % len(SENTENCES) + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", said.alias("said"))
    return readings(rows, "said", F.instr("said", "lidera") - 1).select("p_partkey", "negated", "kind", "hint", "factivity", "action")
