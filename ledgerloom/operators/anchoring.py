"""Quotes and where they stand: fragments of texts, quotes anchored in them, evidence put together again.

A quote is looked for in the one document that it is said to be of. Quotes go to their document in packs, so a document
with any number of quotes is searched by several tasks, each of which reads the text once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.functions.scores import codes
from ledgerloom.operators.lexicon import Norms, Tokens, phrase

#: Quotes in a pack, on average.
PACK = 200
# Lengths of texts that are realigned, of hashes; quotation marks and what is left out.
MOST_EVIDENCE, MOST_DOCUMENT, HASH_DIGITS = 2_000, 200_000, 16
DOUBLE_QUOTES, SINGLE_QUOTES = "«»“”„‟‹›″", "‘’‚‛´`′"
INVISIBLE = frozenset("\u200b\u200c\u200d\u2060\ufeff\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069")
PLAIN_QUOTE = dict.fromkeys(DOUBLE_QUOTES, '"') | dict.fromkeys(SINGLE_QUOTES, "'")
FRAGMENTS = "doc_id long, fragment_id string, index int, start int, end int, content_hash string"
REALIGNED = "quote_id long, doc_id long, tier string, start int, end int, evidence string"
PLACES = "quote_id long, doc_id long, start int, end int, occurrences int"


def map_rows(rows: DataFrame, of: Callable, schema: str) -> DataFrame:
    """The rows that of(row's values) yields, in batches of a hundred input rows."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                found = [r for row in zip(*(c.to_pylist() for c in batch.slice(k, 100).columns)) for r in of(*row)]
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, r)) for r in found], out)

    return rows.mapInArrow(task, schema)


def same_content(text: str) -> str:
    """Composed, with each run of white space as one space, trimmed: what a fragment's hash is made of."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip()


def fragments(documents: DataFrame, most: int | None = None) -> DataFrame:
    """FRAGMENTS of documents (doc_id, text): sentences, which . ! ? or a line feed end, without white space around them,
    numbered from f-001; with `most`, a document's first so many. Blank and null texts have none. text[start:end] is the
    fragment."""
    def of(doc_id, text):
        index = 0
        for m in re.finditer(r"[^.!?\n]*[.!?\n]|[^.!?\n]+", text or ""):
            kept = m.group().strip()
            if kept and (most is None or index < most):
                index += 1
                start = m.start() + len(m.group()) - len(m.group().lstrip())
                yield doc_id, f"f-{index:03d}", index, start, start + len(kept), hashlib.sha256(same_content(kept).encode()).hexdigest()[:HASH_DIGITS]

    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), of, FRAGMENTS)


def reconstructed(evidence: DataFrame, pieces: DataFrame) -> DataFrame:
    """evidence_id, ok, start, end, fragments (by place) and errors of evidence (evidence_id, doc_id, fragment_ids): the span
    from the first to the last fragment named, whatever their order. No ids, a blank one, or one that the document does
    not have is an error, and then there is no span."""
    named = evidence.select("evidence_id", "doc_id", F.explode_outer("fragment_ids").alias("fragment_id"))
    rows = named.join(pieces.select("doc_id", "fragment_id", "index", "start", "end"), ["doc_id", "fragment_id"], "left")
    blank = F.coalesce(F.trim("fragment_id") == "", F.lit(True))
    found = rows.groupBy("evidence_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set(F.struct("index", "fragment_id"))).alias("f"),
        F.bool_or(blank).alias("blank"), F.bool_or(~blank & F.col("index").isNull()).alias("unknown"),
    )
    errors = codes((F.col("blank"), "BLANK_FRAGMENT_ID"), (F.col("unknown"), "UNKNOWN_FRAGMENT_ID"))
    ok = F.size(errors) == 0
    none = F.array().cast("array<string>")
    return found.select(
        "evidence_id", ok.alias("ok"), F.when(ok, F.col("start")).alias("start"), F.when(ok, F.col("end")).alias("end"),
        F.when(ok, F.transform("f", lambda x: x["fragment_id"])).otherwise(none).alias("fragments"), errors.alias("errors"),
    )


def packed(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, text and a pack of quotes (quote_id, quote); a document without a row has a null text.
    Quotes of no document are dropped."""
    packs = quotes.groupBy("doc_id").agg(F.ceil(F.count("*") / PACK).alias("packs"))
    dealt = quotes.join(packs, "doc_id").select("doc_id", "quote_id", "quote", F.pmod(F.xxhash64("quote_id"), F.col("packs")).alias("pack"))
    rows = dealt.groupBy("doc_id", "pack").agg(F.collect_list(F.struct("quote_id", "quote")).alias("quotes"))
    return rows.join(documents.select("doc_id", "text"), "doc_id", "left").select(F.col("doc_id").cast("long"), "text", "quotes")


def normalised(text: str) -> tuple[str, list[int], list[int]]:
    """The text composed, with plain quotation marks, each run of white space as one space and without invisible
    characters; and where in the text each of its characters starts and ends."""
    out, starts, ends, at = [], [], [], 0
    while at < len(text):
        end = at + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        for c in unicodedata.normalize("NFC", text[at:end]):
            if c.isspace() and out and out[-1] == " ":
                ends[-1] = end
            elif c not in INVISIBLE:
                out.append(" " if c.isspace() else PLAIN_QUOTE.get(c, c))
                starts.append(at)
                ends.append(end)
        at = end
    return "".join(out), starts, ends


def places(text: str, quote: str) -> list[int]:
    """Where the quote starts, overlaps included."""
    found, at = [], text.find(quote)
    while at >= 0:
        found.append(at)
        at = text.find(quote, at + 1)
    return found


def realigned(documents: DataFrame, quotes: DataFrame, most_evidence: int = MOST_EVIDENCE, most_document: int = MOST_DOCUMENT) -> DataFrame:
    """REALIGNED: each quote (quote_id, doc_id, quote) with the only span of its document that it can mean.

    tier: exact, if it stands there literally once; normalized, if it does not stand there but, with both sides
    normalised, fits one span; ambiguous, if it fits several; no_match; empty (a blank quote); no_document (an absent or
    empty text); too_long (beyond the limits, which bound the work on a quote). evidence is the document's own text.
    Quotes are distinct by quote_id; a document is one row.
    """
    def of(doc_id, text, pack):
        ready = None
        for q in pack:
            quote, spans, tier = q["quote"], [], None
            if not text:
                tier = "no_document"
            elif not (quote or "").strip():
                tier = "empty"
            elif len(quote) > most_evidence or len(text) > most_document:
                tier = "too_long"
            elif literal := places(text, quote):
                spans, tier = [(s, s + len(quote)) for s in literal], "exact"
            else:
                ready = ready or normalised(text)
                plain, tier = normalised(quote)[0].strip(), "normalized"
                spans = sorted({(ready[1][s], ready[2][s + len(plain) - 1]) for s in places(ready[0], plain)}) if plain else []
                tier = tier if spans else "no_match" if plain else "empty"
            if len(spans) > 1:
                spans, tier = [], "ambiguous"
            start, end = spans[0] if spans else (None, None)
            yield q["quote_id"], doc_id, tier, start, end, text[start:end] if spans else None

    return map_rows(packed(documents, quotes), of, REALIGNED)


def quote_places(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """PLACES of quotes (quote_id, doc_id, quote), white space collapsed, in their documents: the first place where a quote
    stands literally, or else token by token without case and accents, and how many there are. Quotes without a place, and
    blank ones, have no row."""
    def of(doc_id, text, pack):
        tokens = None
        for q in pack:
            quote = re.sub(r"\s+", " ", q["quote"] or "").strip()
            if not text or not quote:
                continue
            spans = [(s, s + len(quote)) for s in places(text, quote)]
            if not spans:
                tokens = tokens or Tokens(text, Norms())
                wanted = phrase(quote)
                n = len(wanted)
                spans = [(tokens.starts[i], tokens.end(i + n - 1)) for i in range(len(tokens.norms) - n + 1) if n and tokens.norms[i : i + n] == wanted]
            if spans:
                yield q["quote_id"], doc_id, *spans[0], len(spans)

    return map_rows(packed(documents, quotes), of, PLACES)


def anchored(documents: DataFrame, quotes: DataFrame, pieces: DataFrame, width: int = 4096) -> DataFrame:
    """quote_id, doc_id, start, end, fragment_id, n_fragments and reasons of quotes that have a place and a fragment of
    pieces (doc_id, fragment_id, start, end) under it.

    The fragment is the shortest that holds the whole place, else the shortest that overlaps it, then the first, then by
    id. Reasons: AMBIGUOUS_ANCHOR (several places; the first counts), SPANS_MULTIPLE_FRAGMENTS. Fragments and places meet
    in bins of `width` characters.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width))).alias("bin")
    found = quote_places(documents, quotes).select("*", bins("start", "end"))
    held = pieces.select("doc_id", "fragment_id", F.col("start").alias("f0"), F.col("end").alias("f1")).select("*", bins("f0", "f1"))
    both = found.join(held, ["doc_id", "bin"]).filter("f0 < end AND start < f1")
    holds = (F.col("f0") <= F.col("start")) & (F.col("end") <= F.col("f1"))
    rank = F.struct((~holds).alias("a"), (F.col("f1") - F.col("f0")).alias("b"), "f0", "fragment_id")
    each = both.groupBy("quote_id", "doc_id", "start", "end", "occurrences").agg(F.min(rank)["fragment_id"].alias("fragment_id"), F.count_distinct("fragment_id").alias("n_fragments"))
    reasons = codes((F.col("occurrences") > 1, "AMBIGUOUS_ANCHOR"), (F.col("n_fragments") > 1, "SPANS_MULTIPLE_FRAGMENTS"))
    return each.select("quote_id", "doc_id", "start", "end", "fragment_id", "n_fragments", reasons.alias("reasons"))
