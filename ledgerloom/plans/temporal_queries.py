"""Queries on expressions of time: each part's brand, then a passage that says when, with what is to be found in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import temporal
from ledgerloom.session import spread, staged
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Passages; what is found: (text, kind, calendar, first day, day after); status and cues.
PASSAGES = [
    ("fundada el 1204-05-31, sigue en pie", [("1204-05-31", "POINT", None, "1204-05-31", "1204-06-01")], "RESOLVED", "STATE_ACTIVE_CUE"),
    ("gobernó desde 1200 hasta 1250 sin pausa", [("desde 1200 hasta 1250 sin pausa", "INTERVAL", None, None, None)], "RESOLVED", "STATE_ENDED_CUE,STATE_STARTED_CUE"),
    ("gobernó desde el año 1200 hasta el año 1250.", [("desde el año 1200 hasta el año 1250", "INTERVAL", None, "1200-01-01", "1251-01-01")], "RESOLVED", "STATE_ENDED_CUE,STATE_STARTED_CUE"),
    ("durante 30 años vivió allí", [("durante 30 años", "DURATION", None, None, None)], "RESOLVED", ""),
    ("durante largos meses, hace 3 días", [("durante largos meses", "DURATION", None, None, None), ("hace 3 días", "RELATIVE", None, None, None)], "RESOLVED", ""),
    ("el 29 de febrero de 1900 y el 28 de febrero de 1900", [("29 de febrero de 1900", "POINT", None, None, None), ("28 de febrero de 1900", "POINT", None, "1900-02-28", "1900-03-01")], "RESOLVED", ""),
    ("en el año 300 de la Tercera Era", [("el año 300", "POINT", "cal-era", None, None)], "RESOLVED", ""),
    ("en el año 300 de otra cosa", [("el año 300", "POINT", None, "0300-01-01", "0301-01-01")], "RESOLVED", ""),
    ("fue en el siglo XII", [("en el siglo XII", "POINT", None, None, None)], "RESOLVED", ""),
    ("ayer llegó, y después de la guerra se fue", [("ayer", "RELATIVE", None, None, None), ("después", "RELATIVE", None, None, None)], "AMBIGUOUS", ""),
    ("nada que decir", [], "NONE", ""), ("ya no vive allí", [], "RESOLVED", "STATE_ENDED_CUE"),
    ("el 5 de setiembre llega", [("5 de setiembre", "POINT", None, None, None)], "RESOLVED", ""), ("dia 2024-13-01", [("2024-13-01", "POINT", None, None, None)], "RESOLVED", ""),
]
CALENDARS = [("cal-luna", ["lunas"]), ("cal-era", ["Tercera Era"])]


def quoted(x):
    return "NULL" if x is None else f"'{x}'"


def passages(spark, sf):
    said = F.element_at(F.array(*[F.lit(p[0]) for p in PASSAGES]), (F.col("p_partkey") % len(PASSAGES) + 1).cast("int"))
    return spread(table(spark, sf, "part").select("p_partkey", "p_brand")).select(F.col("p_partkey").alias("doc_id"), F.concat("p_brand", F.lit(" "), said).alias("text"))


FOUND = "f(k, said, text, kind, calendar_id, first_day, next_day) AS (VALUES " + ", ".join(f"({k}, '{p[0]}', {', '.join(map(quoted, x))})" for k, p in enumerate(PASSAGES) for x in p[1]) + ")"


@query("temporal_expressions", f"""WITH {FOUND} SELECT p_partkey AS doc_id, CAST(length(p_brand) + instr(said, f.text) AS BIGINT) AS start, CAST(length(p_brand) + instr(said, f.text) + length(f.text) AS BIGINT) AS stop, f.text AS text, kind, calendar_id, CAST(first_day AS DATE) AS first_day, CAST(next_day AS DATE) AS next_day
FROM part JOIN f ON f.k = p_partkey % {len(PASSAGES)}""")
def temporal_expressions(spark, sf):
    found = temporal.expressions(passages(spark, sf), CALENDARS)
    return found.select("doc_id", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"), "text", "kind", "calendar_id", "first_day", "next_day")


@query("temporal_resolutions", "WITH t(k, status, cues, n, kinds) AS (VALUES " + ", ".join(f"({k}, '{p[2]}', '{p[3]}', {len(p[1])}, '{','.join(sorted({x[1] for x in p[1]}))}')" for k, p in enumerate(PASSAGES)) + f""")
SELECT p_partkey AS doc_id, status, cues, CAST(n AS BIGINT) AS n, kinds FROM part JOIN t ON t.k = p_partkey % {len(PASSAGES)}""")
def temporal_resolutions(spark, sf):
    rows = passages(spark, sf)
    found = staged(temporal.expressions(rows, CALENDARS), "expressions")  # read twice
    kept = temporal.standalone(found).select("doc_id", "n", F.array_join("kinds", ",").alias("kinds"))
    out = temporal.resolutions(rows, found).join(kept, "doc_id", "left")
    return out.select("doc_id", "status", F.array_join("cues", ",").alias("cues"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kinds", F.lit("")).alias("kinds"))
