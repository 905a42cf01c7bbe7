"""Edges of mutation plans and mentions: nulls, repeated rows, empty inputs, ties."""

from pyspark.sql import functions as F

from ledgerloom.operators import mutation
from ledgerloom.session import dealt


def values(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


DECISION = "plan_id long, claim_id long, a string, predicate string, b string, action string, supersedes long, negated boolean"


def test_plans(spark):
    rows = [
        (1, 1, "A", "OWNS", "B", "ACCEPT", None, None), (1, 2, "B", "OWNS", "A", "ACCEPT", 9, True), (2, 3, "A", "OWNS", "B", "ACCEPT", None, True), (2, 4, "A", "OWNS", "B", "REVIEW", None, False),
        (3, 5, "A", "OWNS", "B", "ACCEPT", None, False), (3, 6, "B", "LIKES", "A", "ACCEPT", None, False), (4, 7, "A", "OWNS", "B", "ACCEPT", None, False), (4, 8, "A", "OWNS", "B", "ACCEPT", None, True),
        (5, 9, "A", "OWNS", "A", "ACCEPT", 1, False),
    ]
    ops = mutation.planned(spark.createDataFrame(rows, DECISION))
    assert values(ops, "claim_id", "place", "op")[:5] == [(1, 0, "CREATE_ASSERTION"), (1, 2, "PROJECT_RELATION"), (2, 0, "CREATE_ASSERTION"), (2, 1, "SUPERSEDE_ASSERTION"), (3, 0, "CREATE_ASSERTION")]
    assert [r.op for r in ops.filter("claim_id = 9").orderBy("place").collect()] == ["CREATE_ASSERTION", "SUPERSEDE_ASSERTION", "PROJECT_RELATION"]
    bad = mutation.inconsistent(ops)  # negated assertions count, other predicates do not
    assert values(bad, "plan_id", "twice", "opposed") == [(1, False, True), (4, True, False)]
    tried = mutation.simulated(ops.union(ops.filter("claim_id = 5")), ops.filter("claim_id = 3"), bad)
    assert {r["outcome"]: r["count"] for r in tried.groupBy("outcome").count().collect()} == {"refused": 7, "skipped": 1, "would_apply": 7, "repeated": 2}
    assert not mutation.inconsistent(ops.limit(0)).count() and not mutation.planned(spark.createDataFrame([], DECISION)).count()


def test_rollback_undoes_what_was_written(spark):
    rows = [
        (1, 1, "NODE", "n1", "e1", None, None), (1, 2, "PROPERTIES", None, "n0", ["status", "valid_to"], {"status": "ACTIVE"}), (1, 3, "RELATIONSHIP", "r1", "n1", None, None), (1, 4, "SIMULATED", None, None, None, None),
        (2, 1, "PROPERTIES", None, "n9", ["status"], None),
    ]
    applied = spark.createDataFrame(rows, "plan_id long, written_at long, kind string, created string, target string, changed array<string>, previous map<string,string>")
    got = [(r.plan_id, r.step, r.action, r.target, r.restore, r.lost) for r in mutation.rollback(applied).orderBy("plan_id", "step").collect()]
    assert got == [
        (1, 1, "DELETE_RELATIONSHIP", "r1", None, []), (1, 2, "RESTORE_PROPERTIES", "n0", {"status": "ACTIVE"}, ["valid_to"]), (1, 3, "DELETE_NODE", "e1", None, []), (2, 1, "RESTORE_PROPERTIES", "n9", None, ["status"]),
    ]


def test_refusals_take_nulls(spark):
    got = spark.range(1).select(mutation.refused(B=F.lit(None).cast("boolean"), A=F.lit(False), C=F.lit(True))).first()[0]
    assert got == ["A", "B"]


def test_endpoints(spark):
    nodes = spark.createDataFrame([(1, None), (2, "x"), (2, "y"), (3, "z")], "node_id int, scope string")
    relations = spark.createDataFrame([(1, 1, 2, "y"), (1, 1, 2, "y"), (2, 2, 3, "x"), (3, 1, 9, "x"), (4, None, 1, None), (5, 2, 1, None)], "rel_id int, a int, b int, scope string")
    assert values(mutation.endpoints(relations, nodes), "rel_id", "ends") == [(1, "ok"), (1, "ok"), (2, "other_scope"), (3, "missing"), (4, "missing"), (5, "other_scope")]


def test_mentions_and_antecedents(spark):
    hits = spark.createDataFrame([(1, 0, 5, 0.5, "a"), (1, 0, 5, 0.9, "b"), (1, 0, 5, 0.9, "b"), (1, 4, 6, 1.0, "c"), (1, 5, 6, 0.1, "d"), (None, 2, 4, 0.1, "e"), (None, 3, 4, 0.1, "g"), (2, 0, 1, None, "f"), (2, None, 1, None, "h")], "text_id int, start int, end int, confidence double, surface string")
    assert sorted(r["surface"] for r in mutation.deduped_mentions(hits).collect()) == ["b", "d", "e", "f"]
    tokens = spark.createDataFrame([(1, 0, "mention", "x"), (1, 1, "pronoun", None), (1, 2, "mention", "y"), (1, 3, "pronoun", None), (1, 9, "pronoun", None), (2, 1, "pronoun", None)], "text_id int, place int, kind string, entity string")
    assert values(mutation.antecedents(tokens, 3), "text_id", "place", "status") == [(1, 1, "resolved"), (1, 3, "ambiguous"), (1, 9, "no_antecedent"), (2, 1, "no_antecedent")]


def test_names(spark):
    terms = spark.createDataFrame([("Ana", 0.5, ["anna", "ANA", " ", None]), ("Bea", 0.9, ["Anna"]), ("Cy", None, None)], "canonical string, confidence double, forms array<string>")
    assert values(mutation.error_forms(terms), "form", "canonical", "confidence") == [("anna", "Bea", 0.9)]
    entities = spark.createDataFrame([(1, "Ann Lee"), (2, "Bob Lee"), (3, None)], "entity int, name string")
    glossary = spark.createDataFrame([("Bob", 7), ("", 8), ("Lee", 9)], "alias string, entity int")
    assert values(mutation.alias_map(entities, glossary), "alias", "entity") == [("ann", 1), ("ann lee", 1), ("bob", 2), ("bob lee", 2), ("lee", 9)]
    paths = [("a/b", True), ("", False), (None, False), ("/a", False), ("c:x", False), ("a/..", False), ("..a", True), ("a\x00", False)]
    rows = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(paths)], "k int, p string").select("k", mutation.safe_path(F.col("p")).alias("safe"))
    assert [s for _, s in values(rows, "k", "safe")] == [s for _, s in paths]


def shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_dealt_plans_are_not_shuffled_again(spark):
    rows = [(1, 1, "A", "OWNS", "B", "ACCEPT", None, False), (1, 1, "A", "OWNS", "B", "ACCEPT", 7, True), (2, 2, "A", "OWNS", "B", "ACCEPT", 1, False)]
    ops = mutation.planned(dealt(spark.createDataFrame(rows, DECISION), 3, "plan_id"))
    assert dealt(ops, 3_000_000, "plan_id").rdd.getNumPartitions() == 10  # a partition holds no more rows when there are more
    assert shuffles(mutation.last_first(ops, "claim_id", "place")) == 1
    got = [(r.plan_id, r.claim_id, r.op, r.step) for r in mutation.last_first(ops.dropDuplicates(["plan_id", "claim_id", "op"]), "claim_id", "place").collect()]
    assert sorted(got) == [(1, 1, "CREATE_ASSERTION", 3), (1, 1, "PROJECT_RELATION", 1), (1, 1, "SUPERSEDE_ASSERTION", 2), (2, 2, "CREATE_ASSERTION", 3), (2, 2, "PROJECT_RELATION", 1), (2, 2, "SUPERSEDE_ASSERTION", 2)]
    tried = mutation.simulated(ops, ops.filter("plan_id = 2"), mutation.inconsistent(ops).limit(0))
    assert values(tried.groupBy("plan_id", "outcome").count(), "plan_id", "outcome", "count") == [(1, "repeated", 1), (1, "would_apply", 3), (2, "skipped", 3)]
    assert values(mutation.inconsistent(ops), "plan_id", "twice", "opposed") == [(1, True, False)]
