"""Text functions as Column expressions: folding, tokens, similarity, quality."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

def decompositions() -> dict[str, str]:
    """Characters whose compatibility decomposition, without its marks, is made of plain letters and digits; signs between
    them are spaces."""
    found = {}
    for code in range(0x80, 0x10000):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(c) != "Mn").lower()
        plain = re.sub("[^0-9a-z]+", " ", base).strip()
        if plain and not 0xD800 <= code < 0xE000 and (base.isascii() or "⁄" in base):
            found[chr(code)] = plain
    return found


def runs(codes: list[int]) -> list[tuple[int, int]]:
    """The first and last of each run of consecutive numbers."""
    firsts = [x for k, x in enumerate(codes) if not k or codes[k - 1] != x - 1]
    lasts = [x for k, x in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != x + 1]
    return list(zip(firsts, lasts))


#: Those that become one letter, and what they become, place by place; and those that become several.
DECOMPOSED = decompositions()
ACCENTED = "".join(c for c, base in DECOMPOSED.items() if len(base) == 1)
FOLDED = "".join(base for base in DECOMPOSED.values() if len(base) == 1)
WIDER = {c: base for c, base in DECOMPOSED.items() if len(base) > 1}
WIDE = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs(sorted(map(ord, WIDER)))) + "]"
#: A class that is soon checked: all of WIDE, and more.
MAY_BE_WIDE = "[\u00bc-\u00be\u0132-\uffff]"


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c made once however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def strip_accents(c: Column) -> Column:
    """Letters and digits by their compatibility decomposition, which is lower-case, without marks; others stay. ASCII texts
    are not touched."""
    plain = lambda x: F.translate(F.regexp_replace(x, r"\p{Mn}+", ""), ACCENTED, FOLDED)
    return bound(c, lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(bound(plain(x), lambda y: F.when(y.rlike(MAY_BE_WIDE), spelled(y)).otherwise(y))))


def spelled(c: Column) -> Column:
    """The text with each character of WIDER as its letters; only the distinct ones that it holds are looked up."""
    each = F.create_map(*[F.lit(x) for pair in WIDER.items() for x in pair])
    there = F.array_distinct(F.regexp_extract_all(c, F.lit(WIDE), F.lit(0)))
    return F.aggregate(there, c, lambda text, x: F.replace(text, x, F.element_at(each, x)))


def fold(c: Column) -> Column:
    """Accent-free, lower-case, everything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(c)), "[^0-9a-z]+", " "))


def any_accent(pattern: str) -> str:
    """A pattern whose plain lower-case letters match their accented forms, composed or not, as well."""
    forms: dict[str, str] = {}
    for c, base in zip(ACCENTED, FOLDED):
        forms[base] = forms.get(base, "") + c
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}{forms.get(m[0], '')}]\\p{{Mn}}*", pattern)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\v]+", " "))


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def tokens(c: Column) -> Column:
    """Tokens of the folded text in order; none for a blank text."""
    return F.filter(F.split(fold(c), " "), lambda t: t != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams of the folded text with n - 1 spaces at both ends."""
    padded = F.concat(F.lit(" " * (n - 1)), fold(c), F.lit(" " * (n - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def similarity(a: Column, b: Column) -> Column:
    """The better of token Jaccard and a mix of edit ratio (3/4) and trigram Jaccard (1/4); 1 for equal folded texts."""
    x, y = fold(a), fold(b)
    mixed = 0.75 * edit_ratio(x, y) + 0.25 * jaccard(ngrams(a, 3), ngrams(b, 3))
    return F.when(x == y, 1.0).otherwise(F.round(F.greatest(mixed, jaccard(token_set(a), token_set(b))), 6))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


#: The spaces of Unicode, no-break ones and those of fixed width among them.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def sentences(c: Column) -> Column:
    """Sentences without spaces of any kind around them: a full stop, question or exclamation mark before white space or a
    line feed ends one."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"([.!?])[ \t]+", "$1\n"), "\n"), lambda s: F.btrim(s, F.lit(SPACES))), lambda s: s != "")


def repeats_in_a_row(c: Column) -> Column:
    """Whether three sentences in a row are the same once folded."""
    sentences = F.filter(F.transform(F.split(c, r"[.\n]"), fold), lambda x: x != "")
    three = lambda s: F.zip_with(s, F.zip_with(F.slice(s, 2, 1 << 30), F.slice(s, 3, 1 << 30), lambda y, z: F.when(y == z, y)), lambda x, y: x == y)
    return bound(sentences, lambda s: F.exists(three(s), lambda x: F.coalesce(x, F.lit(False))))


def quality_flags(c: Column) -> Column:
    """Sorted flags of a text's faults."""

    def of(t: Column) -> Column:
        blank = F.trim(F.regexp_replace(t, r"[\t\n\r\f\v]", " ")) == ""
        faults = F.array(
            F.when(t.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control_chars"),
            F.when(repeats_in_a_row(t), "repeated_content"),
            F.when(F.contains(t, F.lit("�")), "replacement_chars"),
            F.when(F.length(F.trim(t)) < 24, "short_text"),
        )
        return F.when(blank, F.array(F.lit("empty_text"))).otherwise(F.array_compact(faults))

    return bound(F.coalesce(c, F.lit("")), of)


#: What each fault costs.
PENALTIES = {"short_text": 0.10, "replacement_chars": 0.30, "control_chars": 0.20, "repeated_content": 0.25, "empty_text": 1.0}


def quality_score(flags: Column) -> Column:
    cost = sum(F.when(F.array_contains(flags, k), v).otherwise(0.0) for k, v in PENALTIES.items())
    return F.round(F.greatest(F.lit(0.0), 1 - cost), 6)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 32 hex digits of the hash of the parts."""
    return F.concat(F.lit(prefix + "-"), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(32)))


#: Patterns of what redaction masks, and the masks, in order.
MASKS = [
    (r"(token|password) ?= ?\"?[A-Za-z0-9]{8,}\"?", "<secret>"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "<email>"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<ip>"),
]


def redacted(c: Column) -> Column:
    for pattern, mask in MASKS:
        c = F.regexp_replace(c, pattern, mask)
    return c


def percent_label(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits by the reference's length; an empty reference has rate 0 against an empty text, else 1."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.round(F.levenshtein(reference, hypothesis) / n, 6))
