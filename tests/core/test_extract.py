"""Mentions and rule claims: the reading of sentences, overlaps, titles, repeated and odd rows, both ways to find phrases."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.relation_rules import RULES, default_rules
from ledgerloom.operators import lexicon

ENTITIES = [("elara", "Elara", [], "Character", 0.9), ("kael", "Kael", ["el Cuervo"], "Character", 0.9), ("mira", "Mira", None, "Character", 0.9), ("valdor", "Valdor", [], "Location", 0.9),
            ("alba", "Orden del Alba", ["la Orden"], "Faction", 0.8), ("long", "la Orden del Alba Roja", [], "Faction", 0.8)]


@pytest.fixture(scope="module")
def entries(spark):
    named = spark.createDataFrame(ENTITIES, "entry string, name string, aliases array<string>, type string, confidence double")
    titles = spark.createDataFrame([("title", "capitan", "capitán")], "kind string, entry string, surface string").selectExpr("*", "CAST(NULL AS STRING) AS type", "CAST(NULL AS DOUBLE) AS confidence", "CAST(NULL AS BOOLEAN) AS canonical")
    return lexicon.entity_lexicon(named).unionByName(titles).unionByName(lexicon.rule_lexicon(default_rules(spark)))


def texts(spark, *found):
    return spark.createDataFrame(list(enumerate(found)), "text_id long, text string")


def claims(spark, entries, *found):
    out = {}
    for r in lexicon.rule_claims(lexicon.phrase_hits(texts(spark, *found), entries), default_rules(spark)).collect():
        out.setdefault(r.text_id, []).append((r.predicate, r.subject, r.object, r.reasons))
    return out


def test_claims_of_sentences(spark, entries):
    got = claims(
        spark, entries, "Elara pertenece a la Orden del Alba. Kael vive en Valdor.", "Elara y Kael viven en Valdor.", "Kael vive. En Valdor", "Mira junto a Kael vive en Valdor.", "El hermano de Kael vive en Valdor.",
        "Kael es padre de Mira.", "Kael, en paz, vive en Valdor", "Kael vive en aquella muy lejana Valdor", "Kael vive en Valdor y Mira", "Kael vive en Mira", "Tras el abandono de la Orden", "Kael abandonó la Orden del Alba",
        "La Orden del Alba está aún dirigida por Elara",
    )
    assert sorted(got[0]) == [("LIVES_IN", "kael", "valdor", []), ("MEMBER_OF", "elara", "alba", [])]
    assert got[1] == [("LIVES_IN", "kael", "valdor", ["COORDINATED_SUBJECT", "MULTIPLE_SUBJECT_CANDIDATES"])]
    assert 2 not in got and 10 not in got
    assert "COORDINATED_SUBJECT" in got[3][0][3] and got[4][0][3] == ["SUBJECT_IS_MODIFIER"] and got[5] == [("PARENT_OF", "kael", "mira", [])]
    assert got[6][0][3] == ["PUNCTUATION_BETWEEN_ARGUMENTS"] and got[7][0][3] == ["ARGUMENT_TOO_FAR"] and got[8][0][3] == ["COORDINATED_OBJECT"]
    assert got[9] == [("LIVES_IN", "kael", "mira", ["OBJECT_TYPE_MISMATCH"])] and got[11] == [("MEMBER_OF", "kael", "alba", [])]
    assert [c[:3] for c in got[12]] == [("LEADS", "alba", "elara")]


def test_longest_surface_wins_and_places_are_the_text_s(spark, entries):
    text = "ñ 😀 La Órden del Alba Roja, la Orden; el CUERVO y el capitán Juan Pérez de Oro. Elaramir"
    got = lexicon.phrase_hits(texts(spark, text), entries).filter("kind = 'entity'").orderBy("start").collect()
    assert [(r.entry, text[r.start : r.end], r.canonical) for r in got] == [
        ("long", "La Órden del Alba Roja", True), ("alba", "la Orden", False), ("kael", "el CUERVO", False), ("Juan Pérez", "Juan Pérez", True),
    ]
    assert got[1].confidence == pytest.approx(0.68) and got[3].type == "Character"


def test_odd_rows_and_both_ways(spark, entries, monkeypatch):
    rows = [(1, "Kael vive en Valdor"), (1, "Kael vive en Valdor"), (None, "Mira vive en Valdor"), (2, None), (3, ""), (4, "Kael lidera la Orden " * 300), (5, "xyz")]
    frame = spark.createDataFrame(rows, "text_id long, text string")
    found = lambda: sorted(map(str, lexicon.phrase_hits(frame, entries).drop("copy").collect()))
    by_trie = found()
    assert len(lexicon.rule_claims(lexicon.phrase_hits(frame, entries), default_rules(spark)).filter("text_id = 1 AND size(reasons) = 0").collect()) == 2
    monkeypatch.setattr(lexicon, "TRIE_MOST", 3)
    assert found() == by_trie and len(by_trie) > 900
    assert lexicon.phrase_hits(frame.limit(0), entries).count() == 0


def test_rules_are_made_from_paradigms():
    phrases = {p for r in RULES for p in r[4]}
    assert {"esta aun dirigida por", "habian dejado de presidir", "renuncio a la jefatura de"} <= phrases


def test_sentences_decide_what_becomes_of_claims(spark, entries):
    said = [
        "Kael vive en Valdor", "Kael no vive en Valdor", "Kael ya no vive en Valdor", "Se dice que Kael vive en Valdor.", "El magistrado no cree que Kael vive en Valdor", "Si Kael vive en Valdor", "Sí, Kael vive en Valdor",
        "¿Kael vive en Valdor?", "Nadie cree que Kael vive en Valdor", "Kael dejó de servir a la Orden", "Kael no dejó de servir a la Orden", "Es prohibido. Kael vive en Valdor",
    ]
    hits = lexicon.phrase_hits(texts(spark, *said), entries)
    rules = default_rules(spark)
    got = {r.text_id: r for r in lexicon.in_context(lexicon.rule_claims(hits, rules), hits).collect()}
    read = {k: (r.negated, r.kind, r.hint, r.action, r.review) for k, r in got.items()}
    assert read[0] == (False, "", "ASSERTED", "EMIT_WORLD_CLAIM", False) and read[1] == (True, "SIMPLE", "ASSERTED", "EMIT_NEGATED_WORLD_CLAIM", True)
    assert read[2][1] == "CESSATION" and read[3][2:] == ("RUMORED", "EMIT_EPISTEMIC_PROPOSAL", True) and got[3].confidence == pytest.approx(0.8 * got[0].confidence, abs=1e-3)
    assert read[4][3] == "REVIEW_SCOPE" and read[5][3] == "EMIT_DIAGNOSTIC" and read[6][3] == "EMIT_WORLD_CLAIM" and read[7][3] == "EMIT_DIAGNOSTIC" and "FALSITY_CONTEXT" in got[8].context
    assert read[9][1] == "CESSATION" and read[10][1] == "SCOPE_AMBIGUOUS" and read[11][3] == "EMIT_WORLD_CLAIM"


def test_readings_of_nothing(spark):
    from ledgerloom.functions.negation import readings

    rows = spark.createDataFrame([(None, 0), ("", 0), ("vive", 0)], "s string, at int")
    got = [(r.negated, r.hint) for r in readings(rows, "s", F.col("at")).collect()]
    assert got == [(False, "ASSERTED")] * 3
