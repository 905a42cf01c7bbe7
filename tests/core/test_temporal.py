"""Expressions of time: overlaps by priority, places, calendars, days that do not exist, odd rows."""

from datetime import date

from ledgerloom.operators import temporal


def found(spark, *texts, calendars=()):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in temporal.expressions(rows, calendars).orderBy("doc_id", "start").collect():
        assert texts[r.doc_id][r.start : r.end] == r.text
        out.setdefault(r.doc_id, []).append((r.text, r.kind, r.first_day, r.next_day))
    return out


def test_expressions(spark):
    got = found(
        spark, "😀 El AÑO 1200, 1999-12-31 y hoy", None, "", "entre 1200 y 1100", "9999-12-31 0000-01-01", "durante siete largos años", "más tarde, mañana; mañanas", "hace 2 lunas",
        "desde 1200 hasta 1250", "ahora " * 500,
    )
    assert got[0] == [("El AÑO 1200", "POINT", date(1200, 1, 1), date(1201, 1, 1)), ("1999-12-31", "POINT", date(1999, 12, 31), date(2000, 1, 1)), ("hoy", "RELATIVE", None, None)]
    assert 1 not in got and 2 not in got and got[3] == [("entre 1200 y 1100", "INTERVAL", None, None)] and got[4][1] == ("0000-01-01", "POINT", None, None)
    assert got[5] == [("durante siete largos años", "DURATION", None, None)] and [t[0] for t in got[6]] == ["más tarde", "mañana"] and got[7][0][1] == "RELATIVE"
    assert got[8] == [("desde 1200 hasta 1250", "INTERVAL", date(1200, 1, 1), date(1251, 1, 1))] and len(got[9]) == 500


def test_calendars_within_six_tokens(spark):
    rows = spark.createDataFrame([(1, "el año 5 del ciclo de Oro"), (2, "el año 5 a b c d e de Oro"), (3, "el año 5 a b c d e f de Oro"), (4, "hace 3 lunas")], "doc_id long, text string")
    got = {(r.doc_id, r.text): r.calendar_id for r in temporal.expressions(rows, [("oro", ["de Oro", ""]), ("luna", ["lunas"])]).collect()}
    assert got[1, "el año 5"] == "oro" and got[2, "el año 5"] is None and got[3, "el año 5"] is None and got[4, "hace 3 lunas"] == "luna"


def test_overlaps_are_left_out():
    assert temporal.without([(0, 2), (2, 5), (6, 7), (9, 12)], [(3, 4), (7, 9), (11, 20)]) == [(0, 2), (6, 7)]
    assert temporal.without([(0, 2)], []) == [(0, 2)] and temporal.without([], [(0, 2)]) == []
