"""Quotes in texts: the only span they can mean, and the fragment under the first place where they stand."""

import unicodedata

from ledgerloom.operators import anchoring

TEXT = "Dijo: «la Órden» cayó.\r\n​Luego   volvió; volvió.\nElara vive en Valdór. 😀 fin"


def frames(spark, quotes, text=TEXT):
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = [(k, 1, q) for k, q in enumerate(quotes)] + [(100, 2, "x"), (101, 3, "x"), (102, 9, "x"), (103, None, "x")]
    return docs, spark.createDataFrame(rows, "quote_id long, doc_id long, quote string")


def test_only_spans(spark):
    quotes = [
        "la Órden", 'Dijo: "la Órden" cayó', unicodedata.normalize("NFD", "la Órden' cayó").replace("'", "»"), "cayó. Luego volvió", "volvió", "  ", None, "cayo", "Luego‍ volvió;", "x" * 2001, "​ ", "fin",
    ]
    got = {r.quote_id: r for r in anchoring.realigned(*frames(spark, quotes)).collect()}
    tiers = [got[k].tier for k in range(len(quotes))]
    assert tiers == ["exact", "normalized", "normalized", "normalized", "ambiguous", "empty", "empty", "no_match", "normalized", "too_long", "empty", "exact"]
    assert all(r.evidence == TEXT[r.start : r.end] for r in got.values() if r.start is not None)
    assert got[3].evidence == "cayó.\r\n​Luego   volvió" and got[1].evidence == "Dijo: «la Órden» cayó"
    assert [got[k].tier for k in (100, 101, 102)] == ["no_document"] * 3 and 103 not in got


def test_more_quotes_than_a_pack(spark, monkeypatch):
    monkeypatch.setattr(anchoring, "PACK", 2)
    docs, quotes = frames(spark, [TEXT[k : k + 9] for k in range(40)])
    got = {r.quote_id: r for r in anchoring.quote_places(docs, quotes).collect()}
    quoted = {k: " ".join(TEXT[k : k + 9].split()) for k in range(40)}
    assert all(got[k].start == TEXT.index(q) and got[k].end == got[k].start + len(q) for k, q in quoted.items() if q in TEXT) and len(got) >= 30
    assert anchoring.quote_places(docs, quotes.limit(0)).count() == 0


def test_fragments_and_anchors(spark):
    docs, quotes = frames(spark, ["volvió", "elara vive en valdor", "cayó.", "volvió. Elara", "nadie", "", "Valdór. 😀"])
    pieces = anchoring.fragments(docs)
    rows = pieces.orderBy("start").collect()
    assert [TEXT[r.start : r.end] for r in rows] == ["Dijo: «la Órden» cayó.", "​Luego   volvió; volvió.", "Elara vive en Valdór.", "😀 fin"]
    assert [r.fragment_id for r in rows] == ["f-001", "f-002", "f-003", "f-004"] and anchoring.fragments(docs, most=2).count() == 2
    inner = spark.createDataFrame([(1, "name", TEXT.index("Elara"), TEXT.index("Elara") + 5)], "doc_id long, fragment_id string, start int, end int")
    for width in (5, 4096):
        got = {r.quote_id: (r.fragment_id, r.n_fragments, r.reasons) for r in anchoring.anchored(docs, quotes, pieces.select(*inner.columns).union(inner), width).collect()}
        assert got == {
            0: ("f-002", 1, ["AMBIGUOUS_ANCHOR"]), 1: ("f-003", 2, ["SPANS_MULTIPLE_FRAGMENTS"]), 2: ("f-001", 1, []),
            3: ("name", 3, ["SPANS_MULTIPLE_FRAGMENTS"]), 6: ("f-004", 2, ["SPANS_MULTIPLE_FRAGMENTS"]),
        }


def test_reconstructed(spark):
    pieces = anchoring.fragments(frames(spark, [])[0])
    evidence = spark.createDataFrame([(1, 1, ["f-003", "f-001", "f-003"]), (2, 1, ["f-009"]), (3, 1, []), (4, 1, None), (5, 1, ["f-001", " "]), (6, 2, ["f-001"])], "evidence_id long, doc_id long, fragment_ids array<string>")
    got = {r.evidence_id: r for r in anchoring.reconstructed(evidence, pieces).collect()}
    assert (got[1].ok, got[1].start, got[1].end, got[1].fragments) == (True, 0, TEXT.index("Valdór.") + 7, ["f-001", "f-003"])
    assert [got[k].errors for k in range(2, 7)] == [["UNKNOWN_FRAGMENT_ID"], ["BLANK_FRAGMENT_ID"], ["BLANK_FRAGMENT_ID"], ["BLANK_FRAGMENT_ID"], ["UNKNOWN_FRAGMENT_ID"]]
