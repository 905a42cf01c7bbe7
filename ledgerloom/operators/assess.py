"""Judgements on transcripts, relations and runs: quality, signals, direction, predicates, policies, gates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.cues import epistemic_state
from ledgerloom.functions.scores import codes, first_that, ratio
from ledgerloom.functions.text import any_accent

# Thresholds of transcripts and what each fault costs.
LEAST_COVERAGE, MOST_GAP, MOST_TAIL = 0.80, 3.0, 0.05
COSTS = {"LOW_ASR_COVERAGE": 0.25, "TRUNCATED_TAIL": 0.25, "TIMELINE_GAP": 0.10, "REPEATED_CONTENT": 0.25, "NO_DIARIZATION": 0.0}
LOOP = 3


def transcript_quality(transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """id, quality and flags of transcripts (id, duration, diarized) with segments (id, start, end, text).

    A loop is LOOP equal sentences in a row, over segment borders too. A transcript without segments has quality 0. A null
    text says nothing, a null duration tells neither coverage nor tail. A transcript is sorted in one task, which spills.
    """
    order = Window.partitionBy("id").orderBy("start", "end")
    gap = F.coalesce(F.col("start") - F.lag("end").over(order) > MOST_GAP, F.lit(False))
    length = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    times = segments.select("id", "start", "end", length.alias("length"), gap.alias("gap")).groupBy("id").agg(
        F.sum("length").alias("covered"), F.max_by("end", F.struct("start", "end")).alias("last"), F.bool_or("gap").alias("gap")
    )
    parts = segments.select("id", "start", "end", F.posexplode(F.split("text", r"[.\n]")).alias("at", "part"))
    parts = parts.select("id", "start", "end", "at", F.lower(F.trim(F.regexp_replace("part", r"\s+", " "))).alias("part")).filter("part <> ''")
    order = Window.partitionBy("id").orderBy("start", "end", "at")
    same = F.lit(True)
    for k in range(1, LOOP):
        same = same & (F.lag("part", k).over(order) == F.col("part"))
    loops = parts.select("id", F.coalesce(same, F.lit(False)).alias("loop")).groupBy("id").agg(F.bool_or("loop").alias("loop"))
    rows = transcripts.join(times, "id", "left").join(loops, "id", "left")
    timed = F.col("duration") > 0
    faults = {
        "LOW_ASR_COVERAGE": timed & (F.col("covered") / F.col("duration") < LEAST_COVERAGE),
        "TRUNCATED_TAIL": timed & (F.col("duration") - F.col("last") > F.greatest(F.lit(MOST_GAP), F.col("duration") * MOST_TAIL)),
        "TIMELINE_GAP": F.col("gap"),
        "REPEATED_CONTENT": F.col("loop"),
        "NO_DIARIZATION": ~F.coalesce("diarized", F.lit(False)),
    }
    cost = sum((F.when(c, F.lit(COSTS[k])).otherwise(0.0) for k, c in faults.items()), F.lit(0.0))
    empty = F.col("covered").isNull()
    return rows.select(
        "id",
        F.when(empty, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - cost), 6)).alias("quality"),
        F.when(empty, F.array(F.lit("EMPTY_TEXT"))).otherwise(codes(*[(c, k) for k, c in faults.items()])).alias("flags"),
    )


def has_repeat(text: str, block: int, times: int) -> bool:
    """Whether some window of the text stands so many times in it: windows are hashed by rolling sums, in memory that is a few
    numbers a character, and those of a frequent hash are compared."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - block + 1
    if len(codes) < block * times:
        return False
    hashes = np.zeros(n, np.uint64)
    for k in range(block):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]  # modulo 2**64
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    at = np.flatnonzero(ranked[: n - times + 1] == ranked[times - 1 :])
    for k in at:
        window = text[order[k] : order[k] + block]
        if sum(text[p : p + block] == window for p in order[k : np.searchsorted(ranked, ranked[k], "right")]) >= times:
            return True
    return False


def repeats_block(text: Column, block: int = 24, times: int = 3) -> Column:
    """Whether some window of `block` characters stands `times` times in the text; windows may overlap. Null: false."""
    @F.arrow_udf("boolean")
    def judged(texts: pa.Array) -> pa.Array:  # one text at a time is a string
        return pa.array((x.is_valid and has_repeat(x.as_py(), block, times) for x in texts), pa.bool_(), size=len(texts))

    return judged(text)


def range_gaps(chunks: DataFrame, first: int) -> DataFrame:
    """key, gap_start, gap_end and missing between consecutive chunks (key, start, end). first: 1 for pages, whose ends
    are inside the range, 0 for offsets, whose ends are not."""
    before = F.lag("end").over(Window.partitionBy("key").orderBy("start", "end"))
    rows = chunks.select("key", "start", (before + first).alias("gap_start")).filter("start > gap_start")
    return rows.select("key", "gap_start", (F.col("start") - first).alias("gap_end"), (F.col("start") - F.col("gap_start")).alias("missing"))


def phases(rows: DataFrame, cue: str, by: list[str]) -> DataFrame:
    """The columns `by`, place and phase: texts cut before each cue (plain lower-case words), in order, without empty parts.
    Case and accents of the text do not matter, and its parts are as they stand there. A cue starts and ends at words'
    ends."""
    begins = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])(?=(?:{any_accent(cue)})(?![\p{{L}}\p{{M}}\p{{N}}_]))"
    cut = F.regexp_extract_all("text", F.lit(rf"(?s).+?(?={begins}|\z)"), F.lit(0))  # F.split would compile this long pattern for each row
    parts = F.filter(F.transform(cut, lambda x: F.btrim(x, F.lit(" ,.;:-"))), lambda x: x != "")
    return rows.select(*by, F.posexplode(parts).alias("place", "phase"))


def pair_signals(pairs: DataFrame, verbs: list[str]) -> DataFrame:
    """pairs (segment, s_start, s_end, o_start, o_end and others) with chars, same_sentence, same_clause, verb and years.

    Sentences end at . ! ? or a line feed, clauses at , ; or : as well; verb is the first of the verbs, in their order,
    that stands between the mentions as a word. Places count from 0, ends are exclusive.
    """
    lo, hi = F.least("s_start", "o_start"), F.greatest("s_start", "o_start")
    lo_end, hi_end = F.least("s_end", "o_end"), F.greatest("s_end", "o_end")
    cut = lambda a, b: F.substring("segment", a + 1, F.greatest(F.lit(0), b - a))
    rows = pairs.withColumns({"between": cut(lo_end, hi), "upto": cut(lo, hi)})
    words = F.regexp_extract_all(F.lower("between"), F.lit(r"\p{L}+"), F.lit(0))
    same = ~F.col("upto").rlike(r"[.!?\n]")
    return rows.withColumns({
        "chars": F.greatest(F.lit(0), hi - lo_end),
        "same_sentence": same,
        "same_clause": same & ~F.col("upto").rlike("[,;:]"),
        "verb": F.element_at(F.concat(F.filter(F.array(*map(F.lit, verbs)), lambda v: F.array_contains(words, v)), F.array(F.lit(None).cast("string"))), 1),
        "years": F.regexp_extract_all(cut(lo, hi_end), F.lit(r"\b[0-9]{3,4}\b"), F.lit(0)),
    }).drop("between", "upto")


# Fixed values, to TYPE_PAIRS: cues of a relation in its sentence, and the categories that admit a pair of types.
SENTENCE_CUES = {
    "membership": ("miembro de", "miembros de", "pertenece a", "pertenecen a", "pertenecia a", "forma parte de", "forman parte de", "afiliado a", "afiliada a"),
    "possession": ("posee", "poseen", "propietario de", "propietaria de", "dueno de", "en posesion de", "su ", "sus "),
    "location": ("vive en", "viven en", "situado en", "situada en", "ubicado en", "ubicada en", "localizado en", "reside en", "residen en", "se encuentra en", "en la", "en el", " en "),
    "negation": ("no ", "nunca", "jamas", "tampoco", "ni ", "sin "),
    "modality": ("podria", "puede que", "quiza", "quizas", "tal vez", "debe ", "deberia", "tiene que", "es probable", "posiblemente"),
    "rumor": ("se dice que", "segun rumores", "se rumorea", "dicen que", "al parecer", "supuestamente", "se cree que", "se comenta que"),
}
TIME_CUES = ("antes de", "despues de", "durante", "tras ", "mientras", "desde ", "hasta ", "cuando ", "en el ano", "siglo ")
TYPE_PAIRS = {
    "MEMBERSHIP": (("Character", "Faction"), ("Faction", "Faction")), "LOCATION": (("Character", "Location"), ("Object", "Location"), ("Event", "Location"), ("Faction", "Location")),
    "POSSESSION": (("Character", "Object"), ("Faction", "Object"), ("Character", "Concept")), "PARTICIPATION": (("Character", "Event"), ("Faction", "Event")),
}


def pair_window(pairs: DataFrame) -> DataFrame:
    """pairs (segment, s_start, s_end, o_start, o_end and others) with window: the text of the sentences of both mentions and all
    between. A sentence ends with . ! ? or a line feed."""
    before = lambda start: F.length(F.regexp_extract(F.substring("segment", F.lit(1), F.col(start)), r"(?s)^.*[.!?\n]", 0))
    after = lambda end: F.col(end) + F.length(F.regexp_extract(F.substring("segment", F.col(end) + 1, F.length("segment")), r"(?s)^[^.!?\n]*[.!?\n]?", 0))
    rows = pairs.withColumns({"__from": F.least(before("s_start"), before("o_start")), "__to": F.greatest(after("s_end"), after("o_end"))})
    return rows.withColumn("window", F.substring("segment", F.col("__from") + 1, F.col("__to") - F.col("__from"))).drop("__from", "__to")


def cue_signals(pairs: DataFrame) -> DataFrame:
    """pairs (of pair_window, with s_type and o_type) with, for each kind of SENTENCE_CUES, the cue as it stands first in the
    window (null: none); times (sorted, each cue of time once), years; categories (sorted) that admit the types; and the
    epistemic status and nuance of the window. Nothing is decided; a null type admits nothing."""
    low = pairs.withColumn("__low", F.lower("window"))
    place = lambda cue: F.when(F.contains("__low", F.lit(cue)), F.instr("__low", F.lit(cue)))  # noqa: E731  # most are not there, which is soon seen
    literal = lambda at, n: F.substring("window", at, n)

    def first_cue(cues: tuple[str, ...]) -> Column:
        found = F.array_min(F.filter(F.array(*[F.struct(place(c).alias("at"), F.lit(k).alias("k"), F.lit(len(c)).alias("n")) for k, c in enumerate(cues)]), lambda x: x["at"] > 0))
        return literal(found["at"], found["n"])

    times = F.array_sort(F.array_distinct(F.array_compact(F.array(*[literal(place(c), F.lit(len(c))) for c in TIME_CUES]))))
    admits = codes(*[(F.struct("s_type", "o_type").isin(*[F.struct(F.lit(a).alias("s_type"), F.lit(b).alias("o_type")) for a, b in kinds]), name) for name, kinds in TYPE_PAIRS.items()])
    status, nuance = epistemic_state(F.col("window"))
    out = low.withColumns({
        **{name: first_cue(cues) for name, cues in SENTENCE_CUES.items()}, "times": times, "years": F.regexp_extract_all("window", F.lit(r"\b[0-9]{3,4}\b"), F.lit(0)),
        "categories": F.when(F.col("s_type").isNull() | F.col("o_type").isNull(), F.array().cast("array<string>")).otherwise(admits), "status": status, "nuance": nuance,
    })
    return out.drop("__low")


def direction(known: Column, symmetric: Column, between: Column, by: str, active: Column, inverse: Column) -> tuple[Column, Column]:
    """(direction, why) of a pair whose subject comes first: symmetric and unknown predicates have none; an agent after
    the word `by` is the source; then the predicate's own inverse or active phrase; else the order in the text."""
    has = lambda phrase: F.coalesce(F.contains(F.lower(between), F.lower(phrase)), F.lit(False))
    rules = [(symmetric, "symmetric"), (~F.coalesce(known, F.lit(False)), "generic"), (between.rlike(rf"(?i)\b({by})\b"), "passive_agent"), (has(inverse), "lexical_inverse"), (has(active), "lexical_active")]
    why = first_that(*rules, otherwise="textual_order")
    return first_that((why.isin("symmetric", "generic"), "undirected"), (why.isin("passive_agent", "lexical_inverse"), "object_to_subject"), otherwise="subject_to_object"), why


def choose_predicates(pairs: DataFrame, rules: DataFrame, margin: float) -> DataFrame:
    """pair_id, predicate, abstained and why for pairs (pair_id, s_type, o_type, window).

    rules (a configuration table: predicate, family, s_type, o_type, phrases, weight, prior) are broadcast; those of the
    pair's types are scored by phrases found and prior, best first, then most phrases, then name. Without a phrase, or
    too close to another family that has one too, the choice abstains; without any rule it falls back to RELATED_TO.
    """
    hits = F.size(F.filter("phrases", lambda p: F.contains(F.lower("window"), p)))
    scored = pairs.join(F.broadcast(rules), ["s_type", "o_type"]).withColumn("hits", F.coalesce(hits, F.lit(0))).withColumn("score", F.round(F.col("weight") * F.col("hits") + F.col("prior"), 6))
    order = Window.partitionBy("pair_id").orderBy(F.col("score").desc(), F.col("hits").desc(), "predicate")
    next_ = F.lead(F.struct("score", "hits", "family")).over(order)
    best = scored.filter("score > 0").withColumns({"rk": F.row_number().over(order), "next": next_}).filter("rk = 1")
    close = (F.col("next.hits") > 0) & (F.col("next.family") != F.col("family")) & (F.round(F.col("score") - F.col("next.score"), 6) < margin)
    best = best.select("pair_id", "predicate", first_that((F.col("hits") == 0, "prior_only"), (close, "confusable"), otherwise="lexical").alias("why"))
    return pairs.select("pair_id").join(best, "pair_id", "left").select(
        "pair_id", F.coalesce("predicate", F.lit("RELATED_TO")).alias("predicate"), F.coalesce(F.col("why").isin("prior_only", "confusable"), F.lit(False)).alias("abstained"), F.coalesce("why", F.lit("fallback")).alias("why")
    )


def canonical_predicates(raw: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """raw (raw and others) with canonical, status and needs_human by the vocabulary (term, canonical, status), which is
    a configuration table. Upper case, and _ for what is neither letter nor digit, are made before; others are unknown."""
    term = F.btrim(F.regexp_replace(F.upper("raw"), "[^A-Z0-9]+", "_"), F.lit("_"))
    found = raw.withColumn("term", term).join(F.broadcast(vocabulary), "term", "left")
    status = F.coalesce("status", F.lit("unknown"))
    return found.withColumn("status", status).withColumn("needs_human", F.col("status").isin("out_of_vocab", "unknown")).drop("term")


def abstention(findings: dict[str, tuple[str, Column]], predicate: str) -> tuple[Column, Column]:
    """(verdict, sorted reasons) of findings: code -> (rejecting, blocking or informative; condition). A rejection is only
    an abstention where the finding `predicate` holds; a null condition does not hold."""
    any_of = lambda severity: F.exists(F.array(*[F.coalesce(c, F.lit(False)) for s, c in findings.values() if s == severity], F.lit(False)), lambda x: x)
    unsure = F.coalesce(findings[predicate][1], F.lit(False))
    verdict = first_that((any_of("rejecting") & ~unsure, "REJECT"), (any_of("rejecting") | any_of("blocking"), "ABSTAIN"), otherwise="NEUTRAL")
    return verdict, codes(*[(c, code) for code, (_, c) in findings.items()])


def review_label(state: Column, score: Column, providers: Column, evidence: Column, conflicts: Column, least_score: float, least_providers: int = 1) -> Column:
    """AUTO_PROPOSABLE where all conditions hold; a null anywhere asks for a human."""
    sure = (state == "STRONG_CONSENSUS") & (score >= least_score) & ~F.isnan(score) & (providers >= least_providers) & evidence & (conflicts == 0)
    return F.when(sure, "AUTO_PROPOSABLE").otherwise("HUMAN_REQUIRED")


def provider_outcome(marker: Column, reason: Column, seconds: Column) -> Column:
    """transport, responded or indeterminate: a call counts as answered only if something shows that it was."""
    return first_that(
        (marker.startswith("transport_error:") | marker.isin("timeout", "connection_error"), "transport"), (reason == "invalid_candidate", "indeterminate"),
        (marker.isNotNull() | (reason == "invalid_response") | (seconds > 0), "responded"), otherwise="indeterminate",
    )


def outcome_rates(calls: DataFrame, by: str) -> DataFrame:
    """attempted, responded, errors, indeterminate and the rate of errors of calls (by, outcome)."""
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    return calls.groupBy(by).agg(F.count("*").alias("attempted"), is_("responded").alias("responded"), is_("transport").alias("errors"), is_("indeterminate").alias("indeterminate")).withColumn("rate", ratio(F.col("errors"), F.col("attempted"), 4))


def gated(metrics: DataFrame, passes: float, partial: float) -> DataFrame:
    """metrics (value and others) with gate: PASS, PARTIAL, FAIL, or NOT_MEASURED for a null."""
    v = F.col("value")
    return metrics.withColumn("gate", first_that((v.isNull(), "NOT_MEASURED"), (v >= passes, "PASS"), (v >= partial, "PARTIAL"), otherwise="FAIL"))


def run_verdict(gates: DataFrame, by: str, hard: list[str]) -> DataFrame:
    """The verdict of each run over its gates (by, name, gate): unmeasured hard gates say nothing, failed hard gates decide."""
    of = lambda gate: F.bool_or((F.col("gate") == gate) & F.col("name").isin(hard))
    failed = F.count_if((F.col("gate") == "FAIL"))
    verdict = first_that((of("NOT_MEASURED"), "NO_VERDICT"), (of("FAIL"), "NOT_FIT"), (failed > 0, "FIT_WITH_RESERVES"), otherwise="FIT")
    return gates.groupBy(by).agg(verdict.alias("verdict"), failed.alias("failed"))


def negation_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of counts and gates of gold (case_id, family, negated, decision) against predictions (case_id, negated_p,
    kind, decision_p, anchored, scoped). Gold of unknown negation does not count; a case without prediction is wrong in
    all, and counted in missing."""
    rows = gold.filter("negated IS NOT NULL").join(predicted, "case_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    yes, said = F.col("negated"), no(F.col("negated_p"))
    auto = yes & no(F.col("decision") == "AUTO_APPROVE")
    ceased = no(F.col("family") == "NEGATED_CESSATION")
    out = rows.agg(
        F.count("*").alias("cases"), F.count_if(F.col("negated_p").isNull()).alias("missing"), F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"),
        F.count_if(ceased).alias("cessations"), F.count_if(ceased & (F.col("kind") == "CESSATION")).alias("false_cessations"), F.count_if(F.col("anchored")).alias("anchored"),
        F.count_if(F.col("scoped")).alias("scoped"), F.count_if(auto).alias("approvable"), F.count_if(auto & (F.col("decision_p") == "ACCEPT")).alias("approved"),
    )
    return out.withColumns({
        "edges_pass": (F.col("fp") == 0) & (F.col("fn") == 0), "cessation_pass": F.col("false_cessations") == 0, "grounding_pass": (F.col("cases") > 0) & (F.col("anchored") == F.col("cases")),
        "scope_pass": (F.col("cases") > 0) & (F.col("scoped") == F.col("cases")), "approval_pass": (F.col("approvable") > 0) & (F.col("approved") == F.col("approvable")),
    })


def families(origins: DataFrame, rules: DataFrame, unknown: str = "unclassified") -> DataFrame:
    """origins (origin_id, step, provider, name) with family: that of the first matching rule (priority, step, provider,
    name, family; null matches all but in step). rules is a configuration table and broadcast."""
    o, r = origins.alias("o"), F.broadcast(rules).alias("r")
    fits = lambda c: F.col(f"r.{c}").isNull() | (F.col(f"r.{c}") == F.col(f"o.{c}"))
    found = o.join(r, (F.col("o.step") == F.col("r.step")) & fits("provider") & fits("name"), "left")
    return found.groupBy("o.origin_id").agg(F.min_by("r.family", "r.priority").alias("family")).select("origin_id", F.coalesce("family", F.lit(unknown)).alias("family"))
