"""Queries on contracts: every order is a JSON claim, some of which break a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import contracts
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CLAIM = {
    "type": "object", "additionalProperties": False, "required": ["contract_id", "claim_id", "confidence", "subject_mentions", "object_mentions"],
    "properties": {
        "contract_id": {"const": "claim/v1"}, "claim_id": {"$ref": "#/$defs/id"}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "subject_mentions": {"$ref": "#/$defs/ids"}, "object_mentions": {"$ref": "#/$defs/ids"},
        "start": {"type": ["integer", "null"]}, "end": {"type": ["integer", "null"]}, "status": {"enum": ["F", "O", None]},
    },
}
DEFS = {"id": {"type": "string", "minLength": 2, "maxLength": 20, "pattern": "^[a-z]+:"}, "ids": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/$defs/id"}}}
RULES = {"OFFSETS_INVERTED": contracts.inverted("$.start", "$.end"), "SUBJECT_IS_OBJECT": contracts.shared("$.subject_mentions", "$.object_mentions")}

# What each thirteenth order's document is like, after its name, and what is wrong with it.
FAULTS = [
    ('"start":1,"end":2', "", '["m:{k}"]', '["n:1"]', ""), ('"start":3,"end":2', "", '["m:{k}"]', '["n:1"]', "OFFSETS_INVERTED"), ('"start":"x"', "", '["m:{k}"]', '["n:1"]', "TYPE $.start"), ('"odd":1', "", '["m:{k}"]', '["n:1"]', "UNKNOWN $.odd"),
    ('"end":null', "", '["m:{k}"]', '["m:{k}","n:2"]', "SUBJECT_IS_OBJECT"), ('"end":null', "", "[]", '["n:1"]', "MINITEMS $.subject_mentions"), ('"end":null', "", '["m:1","m:1"]', '["n:1"]', "UNIQUEITEMS $.subject_mentions"),
    ('"end":null', "", '["m:1",7]', '["x"]', "MINLENGTH $.object_mentions[],PATTERN $.object_mentions[],TYPE $.subject_mentions[]"), ('"end":1.5', "", '["m:1"]', '["n:1"]', "TYPE $.end"), ('"status":"Z"', "", '["m:1"]', '["n:1"]', "ENUM $.status"), ('"status":null', "", '["m:1"]', '["n:1"]', ""),
    ('"status":"F"', "{{", '["m:1"]', '["n:1"]', "MALFORMED_JSON"), ('"end":3', "", "null", '["n:1"]', "TYPE $.subject_mentions"),
]


@query("contract_rejects", "WITH f(k, rejects) AS (VALUES " + ", ".join(f"({k}, '{f[4]}')" for k, f in enumerate(FAULTS)) + f""")
SELECT o_orderkey, CASE WHEN f.rejects = 'MALFORMED_JSON' THEN f.rejects ELSE array_to_string(list_sort(list_filter(CASE WHEN o_totalprice > 400000 AND f.rejects IN ('OFFSETS_INVERTED', 'SUBJECT_IS_OBJECT') THEN [] ELSE string_split(f.rejects, ',') END || CASE WHEN o_totalprice > 400000 THEN ['MAXIMUM $.confidence'] ELSE [] END, lambda x: x <> '')), ',') END AS rejects
FROM orders JOIN f ON f.k = o_orderkey % {len(FAULTS)}""")
def contract_rejects(spark, sf):
    k = (F.col("o_orderkey") % len(FAULTS) + 1).cast("int")
    pick = lambda i: F.replace(F.element_at(F.array(*[F.lit(f[i]) for f in FAULTS]), k), F.lit("{k}"), F.col("o_orderkey").cast("string"))
    confidence = F.when(F.col("o_totalprice") > 400000, "1.25").otherwise("0.5")
    body = F.concat(pick(1), F.lit('{"contract_id":"claim/v1","claim_id":"o:'), "o_orderkey", F.lit('","confidence":'), confidence, F.lit(',"subject_mentions":'), pick(2), F.lit(',"object_mentions":'), pick(3), F.lit(","), pick(0), F.lit("}"))
    rows = contracts.checked(table(spark, sf, "orders").select("o_orderkey", body.alias("body")), "body", CLAIM, DEFS, RULES)
    return rows.select("o_orderkey", F.array_join("rejects", ",").alias("rejects"))


@query("event_props_rejects", """SELECT event_id, CASE WHEN props IS NULL THEN 'MISSING' WHEN CAST(json_extract(props, '$.k') AS INTEGER) > 90 THEN 'MAXIMUM $.k' ELSE '' END AS rejects FROM events""")
def event_props_rejects(spark, sf):
    """The events' own JSON: an object with a whole number of 90 at most."""
    schema = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 90}}}
    return contracts.checked(table(spark, sf, "events").select("event_id", "props"), "props", schema).select("event_id", F.array_join("rejects", ",").alias("rejects"))
