"""Edges of the judgements: nulls, empty inputs, ties, loops over borders."""

from pyspark.sql import functions as F

from ledgerloom.operators import assess


def values(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_transcript_quality(spark):
    transcripts = spark.createDataFrame([(1, 20.0, True), (2, 100.0, None), (3, None, True), (4, 9.0, True)], "id long, duration double, diarized boolean")
    segments = spark.createDataFrame([(1, 0.0, 9.0, "a. B"), (1, 9.0, 20.0, "b\nb."), (2, 0.0, 10.0, None), (2, 14.0, 15.0, "x"), (3, 0.0, 1.0, "")], "id long, start double, end double, text string")
    found = {r["id"]: (r["quality"], r["flags"]) for r in assess.transcript_quality(transcripts, segments).collect()}
    assert found[1] == (0.75, ["REPEATED_CONTENT"])
    assert found[2] == (0.4, ["LOW_ASR_COVERAGE", "NO_DIARIZATION", "TIMELINE_GAP", "TRUNCATED_TAIL"])
    assert found[3] == (1.0, []) and found[4] == (0.0, ["EMPTY_TEXT"])


def test_repeats_block(spark):
    texts = [None, "", "x" * 71, "x" * 72, "abcdefghijklmnopqrstuvwxyz" * 2, "abcdefghijklmnopqrstuvwxyz" * 3, "😀" * 80]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", assess.repeats_block(F.col("t")).alias("r"))
    assert [r for _, r in values(rows, "k", "r")] == [False, False, False, True, False, True, True]


def test_gaps_and_phases(spark):
    chunks = spark.createDataFrame([("a", 1, 3), ("a", 4, 4), ("a", 8, 9), ("b", 5, 6)], "key string, start long, end long")
    assert values(assess.range_gaps(chunks, 1), "gap_start", "gap_end", "missing") == [(5, 7, 3)]
    assert values(assess.range_gaps(chunks, 0), "gap_start", "gap_end", "missing") == [(3, 4, 1), (4, 8, 4)]
    assert not assess.range_gaps(chunks.limit(0), 1).count()
    texts = spark.createDataFrame([(1, "now so. now"), (2, None), (3, ""), (4, "knowing"), (5, "fue rey, DESPUÉS dejó de serlo"), (6, "dejode, dejó dé él")], "id int, text string")
    assert values(assess.phases(texts.filter("id < 5"), "now", ["id"]), "id", "place", "phase") == [(1, 0, "now so"), (1, 1, "now"), (4, 0, "knowing")]
    told = assess.phases(texts.filter("id > 4"), "despues|dejo de", ["id"])
    assert values(told, "id", "place", "phase") == [(5, 0, "fue rey"), (5, 1, "DESPUÉS"), (5, 2, "dejó de serlo"), (6, 0, "dejode"), (6, 1, "dejó dé él")]


def test_signals(spark):
    pairs = spark.createDataFrame([("Ann leads Bob, in 1999. Cy", 0, 3, 10, 13), ("Ann leads Bob, in 1999. Cy", 24, 26, 10, 13), (None, 0, 1, 2, 3), ("Ann Bob", 0, 3, 2, 5)], "segment string, s_start int, s_end int, o_start int, o_end int")
    got = assess.pair_signals(pairs, ["owns", "leads"]).select("chars", "same_sentence", "same_clause", "verb", "years").collect()
    assert tuple(got[0]) == (7, True, True, "leads", []) and tuple(got[1]) == (11, False, False, None, ["1999"])
    assert got[2]["same_sentence"] is None and got[3]["chars"] == 0


def test_predicates_fall_back(spark):
    rules = spark.createDataFrame([("A_OF", "f", "x", "y", ["a"], 1.0, 0.1), ("B_OF", "g", "x", "y", ["b"], 1.0, 0.1), ("C_OF", "g", "x", "z", ["c"], 1.0, 0.1)], "predicate string, family string, s_type string, o_type string, phrases array<string>, weight double, prior double")
    pairs = spark.createDataFrame([(1, "x", "y", "a"), (2, "x", "y", "a b"), (3, "x", "z", None), (4, None, "y", "a")], "pair_id int, s_type string, o_type string, window string")
    assert values(assess.choose_predicates(pairs, rules, 0.1), "pair_id", "predicate", "why") == [(1, "A_OF", "lexical"), (2, "A_OF", "confusable"), (3, "C_OF", "prior_only"), (4, "RELATED_TO", "fallback")]


def test_policies_take_nulls(spark):
    one = spark.range(1)
    verdict, reasons = assess.abstention({"P": ("blocking", F.lit(None).cast("boolean")), "N": ("rejecting", F.lit(True))}, "P")
    assert tuple(one.select(verdict, reasons).first()) == ("REJECT", ["N"])
    label = lambda score, evidence: assess.review_label(F.lit("STRONG_CONSENSUS"), score, F.lit(1), evidence, F.lit(0), 0.5)
    got = one.select(label(F.lit(0.5), F.lit(True)), label(F.lit(float("nan")), F.lit(True)), label(F.lit(0.9), F.lit(None).cast("boolean"))).first()
    assert tuple(got) == ("AUTO_PROPOSABLE", "HUMAN_REQUIRED", "HUMAN_REQUIRED")


def test_negation_without_predictions(spark):
    gold = spark.createDataFrame([(1, "NEGATED_CESSATION", True, "AUTO_APPROVE"), (2, None, False, None), (3, "x", None, "x")], "case_id int, family string, negated boolean, decision string")
    none = spark.createDataFrame([], "case_id int, negated_p boolean, kind string, decision_p string, anchored boolean, scoped boolean")
    got = assess.negation_metrics(gold, none).first()
    assert (got["cases"], got["missing"], got["fn"], got["approvable"], got["approved"], got["approval_pass"], got["grounding_pass"]) == (2, 2, 1, 1, 0, False, False)


def test_cues_of_a_pair_s_sentences(spark):
    text = "No cuenta. Kael posee, según dicen que Su espada de 1204, en la torre. Fin"
    at = lambda w: (text.index(w), text.index(w) + len(w))
    rows = [(1, text, *at("Kael"), *at("espada"), "Character", "Object"), (2, text, *at("espada"), *at("Kael"), "Object", "Character"), (3, text, *at("Fin"), *at("Fin"), None, "Object"), (4, None, 0, 1, 2, 3, "Character", "Object")]
    pairs = spark.createDataFrame(rows, "id int, segment string, s_start int, s_end int, o_start int, o_end int, s_type string, o_type string")
    got = {r.id: r for r in assess.cue_signals(assess.pair_window(pairs)).collect()}
    assert (got[1].possession, got[1].location, got[1].negation, got[1].rumor, got[1].membership) == ("posee", " en ", None, "dicen que", None)
    assert got[1].years == ["1204"] and got[1].categories == ["POSSESSION"] and got[2].categories == [] and got[3].categories == [] and got[1].status == "RUMORED"
    assert got[3].window.strip() == "Fin" and got[4].window is None and got[2].window == got[1].window
