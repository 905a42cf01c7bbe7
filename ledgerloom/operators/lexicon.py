"""Phrases of a lexicon in texts, mentions, and claims of relations between neighbouring mentions.

One pass over each text finds all phrases of all kinds by a trie of tokens; a lexicon too large for it is joined instead.
What stands next to what (arguments of a phrase, words of coordination, punctuation) is then a matter of windows over the
hits of a sentence.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.functions.negation import readings
from ledgerloom.functions.scores import codes
from ledgerloom.session import staged

#: Rows of a lexicon up to which it is sent to all tasks as a trie.
TRIE_MOST = 200_000
#: Rows of texts that a task scans at a time.
SLICE = 500
#: Kinds that are only reported in sentences that have a rule's phrase.
MARKS = ("coordination", "punctuation")
WORD, BREAK, WEAK = re.compile(r"\w+"), re.compile(r"[.!?;\n\r]+"), re.compile("[,:()—–]")
#: What ends a sentence where the windows of pairs are cut.
STOP = re.compile(r"[.!?\n]")
HITS = (
    "text_id long, copy long, kind string, entry string, type string, confidence double, canonical boolean, start int, end int, "
    "first int, last int, sentence int, last_sentence int, before string"
)
PAIRS = "text_id long, copy long, at int, segment string, s_start int, s_end int, s_type string, o_start int, o_end int, o_type string"
# Tokens and phrases that coordinate, what makes the next mention a modifier, limits.
COORDINATION = ("y", "e", "o", "u", "ni", "y tambien", "o tambien", "asi como", "ni siquiera", "junto a", "junto con", "ademas de", "al igual que", "tanto como", "o a", "o de", "y a")
MODIFIERS = ("de", "del", "por", "para", "segun", "sobre")
COORDINATION_WINDOW, ARGUMENT_GAP, TITLE_NAMES, TITLE_CONFIDENCE = 4, 2, 3, 0.6
ALIAS_FACTOR, RULE_BASE, MOST_CONFIDENCE, REVIEW_BELOW, UNSURE_FACTOR = 0.85, 0.9, 0.9, 0.6, 0.8


def normal(token: str) -> str:
    """The token decomposed, lower-case, without marks and signs."""
    if token.isascii() and token.isalnum():
        return token.lower()
    plain = "".join(c for c in unicodedata.normalize("NFKD", token.lower()) if unicodedata.category(c) != "Mn")
    return re.sub(r"[^\w\s]", "", re.sub(r"[-_/\\]", " ", plain)).strip()


class Norms(dict):
    """Tokens' normal forms, each made once."""

    def __missing__(self, token: str) -> str:
        self[token] = found = normal(token)
        return found


class Tokens:
    """A text's tokens, and for texts that ask for them their places, the sentence of each, and weak punctuation by the token
    behind it."""

    def __init__(self, text: str, norms: Norms):
        self.text, self.words = text, WORD.findall(text)
        self.norms = list(map(norms.__getitem__, self.words))

    @cached_property
    def starts(self) -> list[int]:
        return [m.start() for m in WORD.finditer(self.text)]

    @cached_property
    def breaks(self) -> list[tuple[int, int]]:
        """Where each sentence's text starts, and the mark before it."""
        return [(0, 0), *((m.end(), m.start()) for m in BREAK.finditer(self.text))]

    @cached_property
    def weak(self) -> list[tuple[int, int, int]]:
        places = [m.start() for m in WEAK.finditer(self.text)]
        return [(bisect_left(self.starts, at), self.sentence_at(at), at) for at in places]

    def end(self, i: int) -> int:
        return self.starts[i] + len(self.words[i])

    def sentence_at(self, place: int) -> int:
        return bisect_right(self.breaks, (place, len(self.text))) - 1

    def sentence_of(self, i: int) -> int:
        return self.sentence_at(self.starts[i])

    def sentence(self, k: int) -> tuple[int, str]:
        """Where the sentence starts, and its text without the mark that ends it."""
        start = self.breaks[k][0]
        return start, self.text[start : self.breaks[k + 1][1] if k + 1 < len(self.breaks) else None]


def phrase(surface: str) -> list[str]:
    return [n for n in map(normal, re.findall(r"\w+", surface)) if n]


def trie_of(rows: list) -> dict:
    """Nested tokens; under None the phrase's rows (kind, entry, type, confidence, canonical, surface)."""
    root: dict = {}
    for r in rows:
        node = root
        for token in phrase(r["surface"] or ""):
            node = node.setdefault(token, {})
        if node is not root:
            node.setdefault(None, []).append((r["kind"], r["entry"], r["type"], r["confidence"], r["canonical"], r["surface"]))
    return root


def scan(tokens: Tokens, trie: dict) -> Iterator[tuple[int, int, tuple]]:
    """(first token, last token, row) of all phrases, also those within one another."""
    norms = tokens.norms
    for i in [i for i, norm in enumerate(norms) if norm in trie]:
        node, j = trie[norms[i]], i
        while node:
            for row in node.get(None, ()):
                yield i, j, row
            j += 1
            node = node.get(norms[j]) if j < len(norms) else None


def longest_first(hits: list[tuple]) -> list[tuple]:
    """Hits (first, last, row) without overlaps: the longest first, then the leftmost, then by name and surface."""
    used, kept = set(), []
    for first, last, row in sorted(hits, key=lambda h: (h[0] - h[1], h[0], h[2][1], h[2][5])):
        span = range(first, last + 1)
        if used.isdisjoint(span):
            used.update(span)
            kept.append((first, last, row))
    return kept


def titled(tokens: Tokens, hits: list[tuple]) -> Iterator[tuple]:
    """One to three capitalised tokens behind a title, as a hit of a character of that name."""
    for _, last, _ in hits:
        end = last + 1
        while end < min(len(tokens.words), last + 1 + TITLE_NAMES) and tokens.words[end][0].isupper():
            end += 1
        if end > last + 1:
            name = " ".join(tokens.words[last + 1 : end])
            yield last + 1, end - 1, ("entity", name, "Character", TITLE_CONFIDENCE, True, name)


def mentions_of(tokens: Tokens, found: list[tuple]) -> list[tuple]:
    """Mentions of a text: the lexicon's, longest first, and those behind titles; of overlapping ones the first by place,
    length, confidence and surface stays."""
    hits = longest_first([h for h in found if h[2][0] == "entity"])
    hits += titled(tokens, [h for h in found if h[2][0] == "title"])
    surface = lambda h: h[2][5]
    hits.sort(key=lambda h: (tokens.starts[h[0]], tokens.starts[h[0]] - tokens.end(h[1]), -(h[2][3] or 0), surface(h), h[2][1]))
    kept, until = [], -1
    for h in hits:
        if h[0] > until:
            kept.append(h)
            until = h[1]
    return kept


def text_rows(text_id: int | None, copy: int, tokens: Tokens, found: list[tuple], paired: bool = False) -> list[tuple]:
    """Rows of HITS of a text; marks only in sentences with a rule's phrase, every row once. The word before a mention is of
    the same sentence. paired: only rows of sentences with a rule's phrase and two mentions that end in them."""
    rules = [h for h in found if h[2][0] not in ("entity", "title", *MARKS)]
    mentions = mentions_of(tokens, found) if rules or not paired else []
    if paired:
        inside = Counter(s for first, last, _ in mentions if (s := tokens.sentence_of(first)) == tokens.sentence_of(last))
        rules = [h for h in rules if inside[tokens.sentence_of(h[0])] > 1] if max(inside.values(), default=0) > 1 else []
    sentences = {tokens.sentence_of(h[0]) for h in rules}
    if paired:
        mentions = [h for h in mentions if tokens.sentence_of(h[0]) in sentences]
    marks = [h for h in found if h[2][0] in MARKS and tokens.sentence_of(h[0]) in sentences]
    rows = []
    for first, last, (kind, entry, type_, confidence, canonical, _) in dict.fromkeys([*mentions, *rules, *marks]):
        sentence = tokens.sentence_of(first)
        before = tokens.norms[first - 1] if first and (kind != "entity" or tokens.sentence_of(first - 1) == sentence) else None
        rows.append((text_id, copy, kind, entry, type_, confidence, canonical, tokens.starts[first], tokens.end(last), first, last, sentence, tokens.sentence_of(last), before))
    named = Counter(r[11] for r in rows if r[2] == "entity")
    for s in sentences:
        if named[s] > 1:
            start, said = tokens.sentence(s)
            rows.append((text_id, copy, "sentence", said, None, None, None, start, start + len(said), None, None, s, s, None))
    rows += [(text_id, copy, "punctuation", None, None, None, None, at, at + 1, i, i - 1, s, s, None) for i, s, at in (tokens.weak if sentences else ()) if s in sentences]
    return rows


def pair_rows(text_id: int | None, copy: int, tokens: Tokens, found: list[tuple]) -> list[tuple]:
    """Rows of PAIRS of a text."""
    spans = [(tokens.starts[first], tokens.end(last), row[2]) for first, last, row in mentions_of(tokens, found)] if found else []
    if len(spans) < 2:
        return []
    stops, rows = [m.end() for m in STOP.finditer(tokens.text)], []
    for (s, s_end, s_type), (o, o_end, o_type) in zip(spans, spans[1:]):
        before, behind = bisect_right(stops, s), bisect_right(stops, o_end)
        at = stops[before - 1] if before else 0
        rows.append((text_id, copy, at, tokens.text[at : stops[behind] if behind < len(stops) else None], s - at, s_end - at, s_type, o - at, o_end - at, o_type))
    return rows


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            yield list(zip(*(c.to_pylist() for c in part.columns)))


def phrase_hits(texts: DataFrame, lexicon: DataFrame, paired: bool = False) -> DataFrame:
    """HITS of texts (text_id, text): mentions (kind entity), and all phrases of the other kinds.

    lexicon: kind, entry, surface, and for entities type, confidence and canonical. The kind entity names things, of whose
    overlapping surfaces the longest, then the leftmost counts; title stands before names; coordination is reported in
    sentences with phrases only, punctuation in these too; other kinds are rules' phrases, each reported wherever it
    stands. Phrases match whole tokens, without case and accents; sentences end at . ! ? ; or a line's end. A
    surface without tokens and a null text have no hits; repeated rows have hits of their own (copy tells them apart). Places count code points
    from 0, ends are exclusive; tokens count from 0, last is inclusive; before is the token in front.

    The text of each sentence with a rule's phrase and two mentions is a hit of the kind sentence. paired: only hits of such
    sentences, which are all that rule_claims and in_context look at.

    A lexicon of up to TRIE_MOST rows goes to all tasks; a larger one is joined by the texts' runs of tokens.
    """
    return scanned(texts, lexicon, partial(text_rows, paired=paired), HITS)


def mention_pairs(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """PAIRS of texts (text_id, text): each mention (as phrase_hits finds them) and the next one of its text, in the segment of
    the sentences of both and all between, which ends with . ! ? or a line feed. The segment begins at `at`; the other
    places count from there. Only segments leave the task that reads a text."""
    return scanned(texts, lexicon, pair_rows, PAIRS)


def scanned(texts: DataFrame, lexicon: DataFrame, of: Callable, schema: str) -> DataFrame:
    """The rows that of(text_id, copy, tokens, found phrases) makes of each text."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = ["kind", "entry", "type", "confidence", "canonical", "surface"]
    lexicon, texts = lexicon.select(*columns), texts.select(F.col("text_id").cast("long"), F.monotonically_increasing_id().alias("copy"), "text")
    rows = lexicon.limit(TRIE_MOST + 1).collect()  # a bounded number of rows

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(arrow), arrow)], schema=arrow)

    if len(rows) <= TRIE_MOST:
        shared = texts.sparkSession.sparkContext.broadcast(trie_of(rows))

        def task(batches):
            trie, norms = shared.value, Norms()
            for part in slices(batches):
                if len(norms) > 500_000:
                    norms.clear()
                out = []
                for text_id, copy, text in part:
                    tokens = Tokens(text or "", norms)
                    out += of(text_id, copy, tokens, list(scan(tokens, trie)))
                yield batch_of(out)

        return texts.mapInArrow(task, schema)
    return joined_rows(texts, lexicon, of, schema, batch_of)


def joined_rows(texts: DataFrame, lexicon: DataFrame, of: Callable, schema: str, batch_of: Callable) -> DataFrame:
    """scanned with any lexicon: its phrases and the texts' runs of tokens, as long as the phrases are, meet by key; the
    texts that have some are then scanned by a trie of their own phrases only."""
    columns = lexicon.columns

    def key_task(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_pydict({"key": [" ".join(phrase(r[5] or "")) for r in part], **{c: [r[k] for r in part] for k, c in enumerate(columns)}})

    keyed = lexicon.mapInArrow(key_task, "key string, kind string, entry string, type string, confidence double, canonical boolean, surface string").filter("key <> ''")
    sizes = sorted(r[0] for r in keyed.select(F.size(F.split("key", " "))).distinct().collect())  # lengths of phrases

    def run_task(batches):
        norms = Norms()
        for part in slices(batches):
            if len(norms) > 500_000:
                norms.clear()
            for _, copy, text in part:
                tokens = Tokens(text or "", norms).norms
                keys = {" ".join(tokens[i : i + n]) for n in sizes for i in range(len(tokens) - n + 1)}
                yield pa.RecordBatch.from_pydict({"copy": [copy] * len(keys), "key": list(keys)}, pa.schema([("copy", pa.int64()), ("key", pa.string())]))

    numbered = staged(texts, "numbered")  # both sides see the same numbers
    found = numbered.mapInArrow(run_task, "copy long, key string").join(keyed, "key").select(F.col("copy").alias("of"), *columns)

    def scan_task(some, phrases):
        trie, norms, out = trie_of(phrases.select(columns).to_pylist()), Norms(), []
        for text_id, copy, text in zip(*(some.column(c).to_pylist() for c in ("text_id", "copy", "text"))):
            tokens = Tokens(text or "", norms)
            out += of(text_id, copy, tokens, list(scan(tokens, trie)))
        return pa.Table.from_batches([batch_of(out)])

    return numbered.groupBy("copy").cogroup(found.groupBy("of")).applyInArrow(scan_task, schema)


def rule_lexicon(rules: DataFrame) -> DataFrame:
    """The rules' phrases and the words of coordination as rows of a lexicon."""
    phrases = rules.select(F.lit("rule").alias("kind"), F.col("rule_id").alias("entry"), F.explode("phrases").alias("surface"))
    spoken = rules.sparkSession.createDataFrame([("coordination", c, c) for c in COORDINATION], "kind string, entry string, surface string")
    none = {"type": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "canonical": F.lit(None).cast("boolean")}
    return phrases.union(spoken).withColumns(none)


def entity_lexicon(entities: DataFrame) -> DataFrame:
    """entities (entry, name, aliases, type, confidence) as rows of a lexicon: an alias is less sure than the name."""
    surfaces = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = entities.select("entry", "type", "confidence", "name", F.explode(surfaces).alias("surface"))
    own = F.lower("surface") == F.lower("name")
    return rows.select(F.lit("entity").alias("kind"), "entry", "surface", "type", F.when(own, F.col("confidence")).otherwise(F.col("confidence") * ALIAS_FACTOR).alias("confidence"), own.alias("canonical"))


def rule_claims(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """A row a phrase of a rule with arguments: the nearest mention before and after it in its sentence, and why it is no
    claim, if so.

    rules (a configuration table: rule_id, predicate, direction, confidence, symmetric, subject_types, object_types,
    blocked_before; null arrays allow all) is broadcast. Returns text_id, copy, sentence, rule_id, predicate, direction, start, end, the
    subject's and object's entry and places, reasons (sorted; empty: a claim), confidence and review (null without a
    claim). Phrases without a mention on either side, or behind a blocking word, give no row.
    """
    # Twice the token's number, plus one where a hit ends: what ends before a place comes before it.
    rows = hits.filter(F.col("kind").isin("entity", "rule", *MARKS) & ((F.col("kind") == "rule") | (F.col("sentence") == F.col("last_sentence"))))
    wide = (F.col("kind") == "coordination") & (F.col("first") < F.col("last"))  # a longer one may touch its neighbours
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    me = F.struct("entry", "type", "confidence", "start", "end", "first", "last", "before", "near_before", "near_after")
    group = Window.partitionBy("text_id", "copy", "sentence")
    ends = F.when(F.col("kind") == "rule", 2 * F.col("first")).when(F.col("kind") == "punctuation", 2 * F.col("first") - 1).otherwise(2 * F.col("last") + 1 - F.when(wide, 2).otherwise(0))
    starts = F.when(F.col("kind") == "rule", 2 * F.col("last") + 1).when(F.col("kind") == "punctuation", 2 * F.col("last") + 2).otherwise(2 * F.col("first") + F.when(wide, 2).otherwise(0))
    rows = rows.withColumns({"ends": ends, "starts": starts, "mention_start": 2 * F.col("first"), "mention_end": 2 * F.col("last") + 1})
    joint = of("coordination", F.col("first") + F.when(wide, 1).otherwise(0))
    joint_last = of("coordination", F.col("last") - F.when(wide, 1).otherwise(0))
    # Coordination near a mention itself, seen from its first token back and from its last token on.
    back = group.orderBy(F.when(F.col("kind") == "entity", F.col("mention_start")).otherwise(F.col("ends"))).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    on = group.orderBy(F.when(F.col("kind") == "entity", F.col("mention_end")).otherwise(F.col("starts"))).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns({
        "near_before": F.max(joint).over(back) >= F.col("first") - COORDINATION_WINDOW,
        "near_after": F.min(joint_last).over(on) <= F.col("last") + COORDINATION_WINDOW,
    })
    before = group.orderBy("ends").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = group.orderBy("starts").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    sight = {
        "s": F.max(of("entity", F.struct("last", me.alias("m")))).over(before)["m"], "o": F.min(of("entity", F.struct("first", me.alias("m")))).over(after)["m"],
        "n_before": F.count(of("entity", F.lit(1))).over(before), "n_after": F.count(of("entity", F.lit(1))).over(after),
        "joint_before": F.max(joint).over(before), "joint_after": F.min(joint_last).over(after),
        "weak_before": F.max(of("punctuation", F.col("first"))).over(before), "weak_after": F.min(of("punctuation", F.col("first"))).over(after),
    }
    rows = rows.withColumns(sight).filter("kind = 'rule' AND s IS NOT NULL AND o IS NOT NULL")
    rows = rows.select("text_id", "copy", "sentence", F.col("entry").alias("rule_id"), "start", "end", "first", "last", F.col("before").alias("word_before"), *sight).join(F.broadcast(rules.drop("phrases")), "rule_id")
    rows = rows.filter(~F.coalesce(F.array_contains("blocked_before", F.col("word_before")), F.lit(False)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    other = lambda types, t: yes(F.col(t).isNotNull() & (F.size(types) > 0) & ~F.array_contains(types, F.col(t)))
    reasons = codes(
        ((F.col("first") - F.col("s.last") - 1 > ARGUMENT_GAP) | (F.col("o.first") - F.col("last") - 1 > ARGUMENT_GAP), "ARGUMENT_TOO_FAR"),
        (yes(F.col("joint_before") > F.col("s.last")) | yes(F.col("s.near_before") & (F.col("n_before") > 1)), "COORDINATED_SUBJECT"),
        (yes(F.col("joint_after") < F.col("o.first")) | yes(F.col("o.near_after") & (F.col("n_after") > 1)), "COORDINATED_OBJECT"),
        (yes(F.col("s.before").isin(*MODIFIERS)), "SUBJECT_IS_MODIFIER"),
        (yes(F.col("o.before").isin(*MODIFIERS) & (F.col("o.first") - 1 > F.col("last"))), "OBJECT_IS_MODIFIER"),
        (F.col("n_before") > 1, "MULTIPLE_SUBJECT_CANDIDATES"),
        (yes(F.col("weak_before") > F.col("s.last")) | yes(F.col("weak_after") <= F.col("o.first")), "PUNCTUATION_BETWEEN_ARGUMENTS"),
        (other("object_types", "o.type"), "OBJECT_TYPE_MISMATCH"), (other("subject_types", "s.type"), "SUBJECT_TYPE_MISMATCH"),
    )
    rows = rows.withColumn("reasons", reasons)
    sure = F.least(F.lit(MOST_CONFIDENCE), F.greatest(F.lit(0.0), F.round(F.col("confidence") * F.least("s.confidence", "o.confidence") / RULE_BASE, 4)))
    claimed = F.size("reasons") == 0
    return rows.select(
        "text_id", "copy", "sentence", "rule_id", "predicate", "direction", "start", "end", F.col("s.entry").alias("subject"), F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"),
        F.col("o.entry").alias("object"), F.col("o.start").alias("o_start"), F.col("o.end").alias("o_end"), "reasons",
        F.when(claimed, sure).alias("confidence"), F.when(claimed, sure < REVIEW_BELOW).alias("review"),
    )


def in_context(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """claims (of rule_claims) without reasons, with what their sentence says of them: negated, kind, hint, factivity, action
    and context (codes), and confidence and review as these change them.

    A claim that passed rule_claims has one mention before it in its sentence, so a sentence's text joins few claims.
    """
    said = hits.filter("kind = 'sentence'").select("text_id", "copy", "sentence", F.col("entry").alias("said_in"), F.col("start").alias("said_from"))
    rows = claims.filter(F.size("reasons") == 0).join(said, ["text_id", "copy", "sentence"])
    rows = readings(rows, "said_in", F.col("start") - F.col("said_from"))
    unsure = F.col("hint") != "ASSERTED"
    sure = F.when(unsure, F.round(F.col("confidence") * UNSURE_FACTOR, 4)).otherwise(F.col("confidence"))
    rows = rows.withColumn("confidence", sure).withColumn("review", F.col("negated") | unsure | (F.col("confidence") < REVIEW_BELOW))
    return rows.drop("said_in", "said_from", "reasons")
