"""Schemas as columns: every rule, nested and repeated parts, malformed texts, and rules beyond schemas."""

import json

from ledgerloom.operators import contracts as C


def rejects(spark, schema, *bodies, defs=None, rules=None):
    texts = [b if b is None or isinstance(b, str) and b[:1] == "!" else json.dumps(b) for b in bodies]
    frame = spark.createDataFrame([(k, t.removeprefix("!") if t is not None else None) for k, t in enumerate(texts)], "id int, body string")
    return [r.rejects for r in C.checked(frame, "body", schema, defs, rules).orderBy("id").collect()]


def test_rules(spark):
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {
            "a": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^x"}, "n": {"type": "number", "minimum": 0, "maximum": 1}, "i": {"type": ["integer", "null"]}, "c": {"const": True}, "e": {"enum": ["p", 2, None]},
            "l": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "object", "required": ["k"], "properties": {"k": {"$ref": "#/$defs/k"}}}},
        },
        "if": {"properties": {"e": {"const": "p"}}, "required": ["e"]}, "then": {"required": ["n"]},
    }
    defs = {"k": {"type": "boolean"}}
    got = rejects(
        spark, schema, {"a": "xy", "n": 0.5, "i": 3, "c": True, "e": 2, "l": [{"k": False}]}, {}, {"a": 1}, {"a": "yyyy"}, {"a": "x"}, {"a": "xx", "n": 2, "i": 1.5, "c": False, "e": "q"}, {"a": "xx", "n": -1, "i": None, "e": None},
        {"a": "xx", "l": []}, {"a": "xx", "l": [{"k": True}, {"k": True}, {}]}, {"a": "xx", "l": [{"k": 1}, 5]}, {"a": "xx", "zz": 1, "y": {"a": 2}}, {"a": "xx", "e": "p"}, {"a": "xx", "e": "p", "n": 1}, [1], None, "!{", "!", defs=defs,
    )
    assert got == [
        [], ["REQUIRED $.a"], ["TYPE $.a"], ["MAXLENGTH $.a", "PATTERN $.a"], ["MINLENGTH $.a"], ["CONST $.c", "ENUM $.e", "MAXIMUM $.n", "TYPE $.i"], ["MINIMUM $.n"], ["MINITEMS $.l"], ["MAXITEMS $.l", "REQUIRED $.l[].k", "UNIQUEITEMS $.l"],
        ["TYPE $.l[]", "TYPE $.l[].k"], ["UNKNOWN $.y", "UNKNOWN $.zz"], ["REQUIRED $.n"], [], ["TYPE $"], ["MISSING"], ["MALFORMED_JSON"], ["MALFORMED_JSON"],
    ]


def test_rules_beyond_schemas(spark):
    rules = {
        "INVERTED": C.inverted("$.start", "$.end"), "SELF": C.same("$.subject", "$.object"), "HASH": C.differ("$.h", "$.g"), "BOTH": C.shared("$.s", "$.o"), "OWN": C.holds_itself("$.near", "$.id"), "NO_BOX": C.needs("$.type", ("MAP", "OCR"), "$.box"),
        "UNSORTED": C.unsorted("$.p", "confidence", "predicate"),
    }
    p = lambda *x: {"p": [{"predicate": n, "confidence": c} for n, c in x]}
    got = rejects(
        spark, {"type": "object"}, {"start": 2, "end": 1}, {"start": 2, "end": None}, {"subject": "a", "object": "a"}, {"h": {"v": 1}, "g": {"v": 2}}, {"h": {"v": 1}, "g": {"v": 1}}, {"s": ["a", "b"], "o": ["b"]}, {"near": ["x"], "id": "x"},
        {"type": "MAP"}, {"type": "MAP", "box": None}, {"type": "OCR", "box": {"x": 1}}, {"type": "OCR", "box": ""}, {"type": "TEXT"}, p(("a", 0.9), ("b", 0.5), ("c", 0.5)), p(("c", 0.5), ("b", 0.5)), p(("a", 0.5), ("b", 0.9)), p(("a", 0.9), ("a", 0.5)), {}, rules=rules,
    )
    assert got == [["INVERTED"], [], ["SELF"], ["HASH"], [], ["BOTH"], ["OWN"], ["NO_BOX"], ["NO_BOX"], [], ["NO_BOX"], [], [], ["UNSORTED"], ["UNSORTED"], ["UNSORTED"], []]


def test_lines(spark):
    texts = spark.createDataFrame([(1, '{"a":1}\n\n{"a":"x"}\r\nnope\n{"a":2}'), (2, None), (3, "")], "text_id int, text string")
    got = [(r.line, r.rejects) for r in C.checked_lines(texts, {"properties": {"a": {"type": "integer"}}}, 3).orderBy("text_id", "line").collect()]
    assert got == [(1, []), (3, ["TYPE $.a"]), (4, ["MALFORMED_JSON"]), (5, ["TOO_MANY_RECORDS"])]
