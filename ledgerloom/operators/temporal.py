"""Expressions of time in texts, where they stand, what they fix, and whether a passage's time can be told from it alone."""

from __future__ import annotations

import calendar
import re
from datetime import date

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.scores import codes, first_that
from ledgerloom.operators.anchoring import map_rows
from ledgerloom.operators.lexicon import normal, phrase

# Fixed values, to LOOKAHEAD: months, the patterns from the most specific on with their kinds, cues of state.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
MONTH = "|".join([*MONTHS, "setiembre"])
PATTERNS = [
    (r"\b\d{4}-\d{2}-\d{2}\b", "POINT"),
    (r"\b(?:desde|entre)\s+(?:el\s+)?(?:a[nñ]o\s+)?[\wáéíóúñ]+(?:\s+[\wáéíóúñ]+){0,4}?\s+(?:hasta|y)\s+(?:el\s+)?(?:a[nñ]o\s+)?[\wáéíóúñ]+(?:\s+[\wáéíóúñ]+){0,4}\b", "INTERVAL"),
    (r"\bdurante\s+(?:\w+\s+)?\d+\s+(?:a[nñ]os?|meses|mes|d[ií]as?|siglos?|lunas?)\b", "DURATION"),
    (r"\bdurante\s+(?:\w+\s+){0,2}(?:a[nñ]os?|meses|d[ií]as?|siglos?|lunas?)\b", "DURATION"),
    (r"\bhace\s+\d+\s+(?:a[nñ]os?|meses|d[ií]as?|siglos?|lunas?)\b", "RELATIVE"),
    (rf"\b\d{{1,2}}\s+de\s+(?:{MONTH})(?:\s+de\s+\d{{1,4}})?\b", "POINT"),
    (r"\b(?:el\s+)?a[nñ]o\s+\d{1,5}\b", "POINT"),
    (r"\b(?:en\s+)?el\s+(?:siglo|ciclo)\s+[\w]+\b", "POINT"),
    (r"\b(?:ayer|hoy|ma[nñ]ana|anoche|entonces|ahora|antes|despu[eé]s|m[aá]s tarde)\b", "RELATIVE"),
    (r"\b(?:antes|despu[eé]s)\s+de\s+(?:la|el|los|las)\s+[\wáéíóúñ]+\b", "RELATIVE"),
]
STATE_CUES = {"STATE_ENDED_CUE": ("ya no", "dejo de", "hasta"), "STATE_ACTIVE_CUE": ("todavia", "aun", "sigue", "conserva"), "STATE_STARTED_CUE": ("desde",)}
LOOKAHEAD = 6
EXPRESSIONS = "doc_id long, start int, end int, text string, kind string, pattern int, calendar_id string, first_day date, next_day date, precision string"


def day(y: int, m: int = 1, d: int = 1) -> date | None:
    return date(y, m, d) if 1 <= y <= 9999 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1] else None


def fixed(text: str) -> tuple[date | None, date | None, str | None]:
    """(first day, the day after the last, precision) of an expression that names days or years of the common calendar; a
    day without a year, and whatever counts from now, fixes nothing. An interval goes from its first year to its last."""
    low = normal(text) if not re.match(r"\d{4}-", text) else text
    if m := re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", low):
        first = day(*map(int, m.groups()))
    elif m := re.fullmatch(rf"(\d{{1,2}})\s+de\s+({MONTH})\s+de\s+(\d{{1,4}})", low):
        month = MONTHS.index(m[2].replace("setiembre", "septiembre")) + 1
        first = day(int(m[3]), month, int(m[1]))
    elif m := re.fullmatch(r"(?:el\s+)?ano\s+(\d{1,5})", low):
        return day(int(m[1])), day(int(m[1]) + 1), "year" if day(int(m[1])) else None
    elif m := re.fullmatch(r"(?:desde|entre)\s+(?:el\s+)?(?:ano\s+)?(\d{1,4})\s+(?:hasta|y)\s+(?:el\s+)?(?:ano\s+)?(\d{1,4})", low):
        first, last = day(int(m[1])), day(int(m[2]) + 1)
        return (first, last, "year") if first and last and first < last else (None, None, None)
    else:
        return None, None, None
    return (first, date.fromordinal(min(first.toordinal() + 1, date.max.toordinal())), "day") if first else (None, None, None)


def expressions(documents: DataFrame, calendars: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """EXPRESSIONS of documents (doc_id, text): what each pattern finds, without what overlaps a find of an earlier one.

    calendars: ids with the labels of their eras and units; an expression belongs to the first calendar one of whose labels
    stands at its end or within LOOKAHEAD tokens behind it. first_day and next_day (the day after) bound what it fixes, to
    a precision of days or years, for expressions of no such calendar. Places count code points from 0, ends are
    exclusive; null texts have none.
    """
    compiled = [(re.compile(p, re.IGNORECASE), kind) for p, kind in PATTERNS]
    labels = [(name, [phrase(x) for x in named if phrase(x)]) for name, named in calendars]

    def calendar_of(text: str, start: int, end: int) -> str | None:
        inside = phrase(text[start:end])
        behind = []
        for m in re.finditer(r"\w+", text[end:]):
            behind.append(normal(m.group()))
            if len(behind) == LOOKAHEAD:
                break
        for name, named in labels:
            for label in named:
                near = inside[-len(label) :] + behind
                if any(near[k : k + len(label)] == label for k in range(len(near) - len(label) + 1)):
                    return name
        return None

    def of(doc_id, text):
        taken: list[tuple[int, int]] = []
        found = []
        for k, (pattern, kind) in enumerate(compiled):
            mine = [m.span() for m in pattern.finditer(text or "")]
            kept = without(mine, taken)
            taken = sorted(taken + kept)
            found += [(s, e, kind, k) for s, e in kept]
        for s, e, kind, k in sorted(found):
            name = calendar_of(text, s, e) if labels else None
            yield doc_id, s, e, text[s:e], kind, k, name, *(fixed(text[s:e]) if name is None else (None, None, None))

    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), of, EXPRESSIONS)


def without(mine: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of mine that overlap none of taken; both are sorted and free of overlaps themselves."""
    kept, k = [], 0
    for s, e in mine:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            kept.append((s, e))
    return kept


def resolutions(passages: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """passages (doc_id, text) with status, cues and reasons: NONE without expressions and cues of state, AMBIGUOUS if all
    expressions are relative and at least one is, else RESOLVED. found: expressions of the same passages, one row each."""
    kinds = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "RELATIVE").alias("relative"))
    folded = T.fold(F.col(text))
    rows = passages.withColumn("__folded", folded).join(kinds, "doc_id", "left")
    n, relative = F.coalesce("n", F.lit(0)), F.coalesce("relative", F.lit(0))
    cues = codes(*[(F.col("__folded").rlike("|".join(words)), code) for code, words in STATE_CUES.items()])
    rows = rows.withColumn("cues", F.coalesce(cues, F.array().cast("array<string>")))
    status = first_that(((n == 0) & (F.size("cues") == 0), "NONE"), ((n > 0) & (relative == n), "AMBIGUOUS"), otherwise="RESOLVED")
    reasons = codes((status == "AMBIGUOUS", "TEMPORAL_RELATIVE_WITHOUT_ANCHOR"))
    return rows.withColumns({"status": status, "reasons": reasons}).drop("__folded", "n", "relative")


def standalone(found: DataFrame) -> DataFrame:
    """doc_id, n, kinds and reasons of each text with expressions of time: a proposal that claims nothing and keeps them."""
    rows = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"))  # four kinds
    return rows.withColumn("reasons", F.array(F.lit("TEMPORAL_EXPRESSION_WITHOUT_CLAIM")))
