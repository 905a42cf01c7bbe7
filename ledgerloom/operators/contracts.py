"""Contracts compiled to checks: a schema becomes one column that lists what is wrong with a JSON document.

Documents are parsed once into variants; every rule is an expression on them, so a table of any size is checked within one
scan, and malformed documents stay, with their own code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

NONE = "array<string>"


def none() -> Column:
    return F.array().cast(NONE)


def when_codes(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules])) if rules else none()


def kind_of(x: Column) -> Column:
    """A variant's JSON type: object, array, string, integer (whole decimals too), number, boolean or null."""
    s = F.schema_of_variant(x)
    whole = (s == "BIGINT") | s.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(whole, "integer").otherwise("number")
    )


def value(x: Column, path: str, kind: str) -> Column:
    """What stands at a path of a variant, as a type; null if it is absent or something else."""
    return F.try_variant_get(x, path, kind)


def resolve(schema: dict, defs: dict) -> dict:
    """The schema that a $ref names by its last part, with what stands beside the $ref."""
    if "$ref" not in schema:
        return schema
    return resolve(defs[schema["$ref"].rsplit("/", 1)[-1]], defs) | {k: v for k, v in schema.items() if k != "$ref"}


def failures(x: Column, schema: dict, defs: dict, name: str = "$") -> Column:
    """Codes of what is wrong with a variant (a null column is an absent value: nothing). RULE path, for the rules type,
    const, enum, minLength, maxLength, pattern, minimum, maximum, minItems, maxItems, uniqueItems, items, required,
    properties, additionalProperties: false, and if/then over these. Elements of an array share the path name[]."""
    schema = resolve(schema, defs)
    allowed = schema.get("type", [])
    allowed = [allowed] if isinstance(allowed, str) else list(allowed)
    kind = kind_of(x)
    fits = kind.isin(*allowed, *(["integer"] if "number" in allowed else [])) if allowed else F.lit(True)
    text, number = value(x, "$", "string"), value(x, "$", "double")
    is_ = lambda k: kind == k
    simple: list[tuple[Column, str]] = [(~fits, f"TYPE {name}")]
    if "const" in schema:
        simple.append((~text.eqNullSafe(F.lit(plain(schema["const"]))), f"CONST {name}"))
    if "enum" in schema:
        simple.append((~F.coalesce(text.isin(*[plain(v) for v in schema["enum"] if v is not None]), F.lit(False)) & ~(is_("null") & F.lit(None in schema["enum"])), f"ENUM {name}"))
    for rule, wrong in (("minLength", lambda n: F.length(text) < n), ("maxLength", lambda n: F.length(text) > n), ("pattern", lambda p: ~text.rlike(p))):
        if rule in schema:
            simple.append((is_("string") & wrong(schema[rule]), f"{rule.upper()} {name}"))
    for rule, wrong in (("minimum", lambda n: number < n), ("maximum", lambda n: number > n)):
        if rule in schema:
            simple.append((kind.isin("integer", "number") & wrong(schema[rule]), f"{rule.upper()} {name}"))
    parts = []
    if {"items", "minItems", "maxItems", "uniqueItems"} & set(schema):
        elements = value(x, "$", "array<variant>")
        size = F.size(elements)
        for rule, wrong in (("minItems", lambda n: size < n), ("maxItems", lambda n: size > n)):
            if rule in schema:
                simple.append((is_("array") & wrong(schema[rule]), f"{rule.upper()} {name}"))
        if schema.get("uniqueItems"):
            shown = F.transform(elements, lambda e: F.to_json(e))
            simple.append((is_("array") & (F.size(F.array_distinct(shown)) < size), f"UNIQUEITEMS {name}"))
        if "items" in schema:
            parts.append(F.when(is_("array"), F.array_distinct(F.flatten(F.transform(elements, lambda e: failures(e, schema["items"], defs, f"{name}[]"))))))
    fields = lambda k: value(x, f"$['{k}']", "variant")
    for k in schema.get("required", []):
        simple.append((is_("object") & fields(k).isNull(), f"REQUIRED {name}.{k}"))
    for k, sub in schema.get("properties", {}).items():
        parts.append(F.when(is_("object"), failures(fields(k), sub, defs, f"{name}.{k}")))
    if schema.get("additionalProperties") is False:
        known = list(schema.get("properties", {}))
        keys = F.map_keys(value(x, "$", "map<string,variant>"))
        parts.append(F.when(is_("object"), F.transform(F.filter(keys, lambda k: ~k.isin(*known) if known else F.lit(True)), lambda k: F.concat(F.lit(f"UNKNOWN {name}."), k))))
    if "if" in schema and "then" in schema:
        parts.append(F.when(F.size(failures(x, schema["if"], defs, name)) == 0, failures(x, schema["then"], defs, name)))
    every = F.concat(when_codes(*[(F.coalesce(c, F.lit(False)), code) for c, code in simple]), *[F.coalesce(p, none()) for p in parts])
    return F.when(x.isNull(), none()).otherwise(every)


def plain(v: object) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def checked(documents: DataFrame, body: str, schema: dict, defs: dict | None = None, rules: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """documents with rejects: the sorted codes of what is wrong with each JSON text in `body`; none if it keeps its contract.

    rules are further conditions by code, from the parsed document to whether it breaks the rule (null: it does not); they
    count for documents that fit the schema, as they rest on its types. A null text is MISSING, one that is no JSON
    MALFORMED_JSON.
    """
    rows = documents.withColumn("__doc", F.try_parse_json(body))
    rows = rows.withColumn("__shape", failures(F.col("__doc"), schema, defs or {}))
    broken = when_codes(*[(F.coalesce(rule(F.col("__doc")), F.lit(False)), code) for code, rule in (rules or {}).items()])
    rejects = (
        F.when(F.col(body).isNull(), F.array(F.lit("MISSING"))).when(F.col("__doc").isNull(), F.array(F.lit("MALFORMED_JSON")))
        .when(F.size("__shape") > 0, F.array_sort(F.array_distinct("__shape"))).otherwise(F.array_sort(broken))
    )
    return rows.withColumn("rejects", rejects).drop("__doc", "__shape")


# ---- rules that schemas cannot say, for use with checked()

def inverted(start: str, end: str, kind: str = "double") -> Callable[[Column], Column]:
    """The start is behind the end; either may be null."""
    return lambda d: value(d, start, kind) > value(d, end, kind)


def same(a: str, b: str) -> Callable[[Column], Column]:
    return lambda d: value(d, a, "string") == value(d, b, "string")


def differ(a: str, b: str) -> Callable[[Column], Column]:
    """Both are given and not the same, whatever their type."""
    return lambda d: F.to_json(value(d, a, "variant")) != F.to_json(value(d, b, "variant"))


def shared(a: str, b: str) -> Callable[[Column], Column]:
    """Two lists of names have one in common."""
    return lambda d: F.arrays_overlap(value(d, a, "array<string>"), value(d, b, "array<string>"))


def holds_itself(names: str, name: str) -> Callable[[Column], Column]:
    return lambda d: F.array_contains(value(d, names, "array<string>"), value(d, name, "string"))


def needs(field: str, values: tuple[str, ...], *fields: str) -> Callable[[Column], Column]:
    """Where a field has one of the values, the others must be given, and not empty."""
    def rule(d: Column) -> Column:
        absent = [F.coalesce(value(d, f, "string"), F.when(F.coalesce(value(d, f, "variant").isNotNull() & (kind_of(value(d, f, "variant")) != "null"), F.lit(False)), F.lit("given")), F.lit("")) == "" for f in fields]
        any_absent = absent[0]
        for a in absent[1:]:
            any_absent = any_absent | a
        return value(d, field, "string").isin(*values) & any_absent

    return rule


def unsorted(path: str, confidence: str, name: str) -> Callable[[Column], Column]:
    """Candidates are not in the order of falling confidence, then of the name, or name one twice."""
    def rule(d: Column) -> Column:
        items = F.transform(value(d, path, "array<variant>"), lambda e: F.struct((-value(e, f"$.{confidence}", "double")).alias("c"), value(e, f"$.{name}", "string").alias("n")))
        return (items != F.array_sort(items)) | (F.size(F.array_distinct(F.transform(items, lambda i: i["n"]))) < F.size(items))

    return rule


def checked_lines(texts: DataFrame, schema: dict, most: int, defs: dict | None = None) -> DataFrame:
    """text_id, line (from 1) and rejects of the lines of texts (text_id, text) that hold one JSON document each; blank lines
    are none. A text of more than `most` documents has TOO_MANY_RECORDS on each beyond them."""
    lines = texts.select("text_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "body")).filter(F.trim("body") != "")
    rows = checked(lines, "body", schema, defs)
    beyond = F.count("*").over(Window.partitionBy("text_id").orderBy("pos")) > most
    return rows.select("text_id", (F.col("pos") + 1).alias("line"), F.when(beyond, F.array(F.lit("TOO_MANY_RECORDS"))).otherwise(F.col("rejects")).alias("rejects"))

