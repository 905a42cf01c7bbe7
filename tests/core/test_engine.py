"""Moves of the ledger, chains, decisions, Markdown and quotes on small tables with known results."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import decision, ingest, markdown, moves, policy
from ledgerloom.plans import catalog
from ledgerloom.session import staged

SF = "/root/testdata/sf0.001"


def test_quotes_of_any_length_are_found(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "a b"), (3, None), (4, ""), (5, "überall im Land"), (6, "hello xyz\n"), (7, "line one\nline two\n"), (8, "😀ab cd")], "doc_id long, text string")
    quotes = ["quick brown fox", "ck bro", "the quick brown fox jum", "uick brown fox ju", "b", "a ", "x", "", "quick brown", "rall im La", "k brown fox jumps ov", None, "xyz", "z", "two", "two\n", "\n", "😀a", "😀", "one\nl"]
    rows = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    got = sorted((r.doc_id, r.quote_id, r.place) for r in ingest.anchored_quotes(docs, rows).collect())
    want = sorted((d.doc_id, i, d.text.index(q) + 1) for d in docs.collect() for i, q in enumerate(quotes) if q and d.text and q in d.text)
    assert got == want and len(got) > 10
    assert ingest.anchored_quotes(docs, rows.limit(0)).count() == 0


def test_chains_and_cycles(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(40, None), (100, 101), (101, 102), (102, 100), (103, 100), (7000, 7001)]
    rows = spark.createDataFrame(links, "id long, successor long")
    got = {r.id: (r.last, r.steps, r.cycle) for r in moves.chain_ends(rows, lambda x: staged(x, "test")).collect()}
    assert all(got[k] == (40, 40 - k, False) for k in range(1, 40)) and got[7000] == (7001, 1, False) and 40 not in got
    assert all(got[k] == (None, None, True) for k in (100, 101, 102, 103))
    assert moves.chain_ends(rows.limit(0), lambda x: staged(x, "test")).count() == 0


def test_one_altered_entry_is_found(spark):
    rows = spark.createDataFrame([(k, f"a{k % 3}", k, "ACTIVE", k / 100) for k in range(30)], "seq long, assertion_id string, recorded_at long, status string, confidence double")
    stored = rows.join(moves.sealed(rows), ["seq", "assertion_id"])
    assert moves.broken(stored).count() == 0
    altered = stored.withColumn("confidence", F.when(F.col("seq") == 7, 0.9).otherwise(F.col("confidence")))
    assert [tuple(r) for r in moves.broken(altered).collect()] == [(7, "a1", "altered")]
    # A dropped entry leaves the next one without its link.
    assert [(r.seq, r.fault) for r in moves.broken(stored.filter("seq <> 7")).collect()] == [(10, "unlinked")]
    # An entry sealed anew after a change breaks the one that follows it.
    forged = stored.withColumn("entry_hash", F.when(F.col("seq") == 7, F.lit("f" * 64)).otherwise(F.col("entry_hash")))
    assert sorted((r.seq, r.fault) for r in moves.broken(forged).collect()) == [(7, "altered"), (10, "unlinked")]


def test_commands_are_refused_or_make_versions(spark):
    schema = "operation string, assertion_id string, was string, held double, revision long, closed boolean, new_status string, new_confidence double, new_evidence int, live_twins int, other_id string, other_was string, other_held double, other_revision long, successor_id string"
    base = ("a", "ACTIVE", 0.5, 3, False, "ACTIVE", 0.6, 1, 0, "b", "ACTIVE", 0.4, 2, "a2")
    row = lambda op, **x: (op, *[x.get(k, v) for k, v in zip(("id", "was", "held", "revision", "closed", "status", "confidence", "evidence", "twins", "other", "other_was", "other_held", "other_revision", "successor"), base)])
    rows = [row("assert"), row("assert", was=None, status="ENDED"), row("assert", was=None, twins=1), row("assert", was=None), row("confirm", was=None), row("confirm", was="RETRACTED"), row("confirm", was="PLANNED"), row("confirm", evidence=0), row("confirm", confidence=0.4), row("confirm"), row("supersede"), row("contradict", other_was=None), row("contradict"), row("retract"), row("close", closed=True), row("close", was="PLANNED"), row("close")]
    got = [tuple(r) for r in moves.moved(spark.createDataFrame(rows, schema)).collect()]
    reasons = sorted(x[1] for x in got if x[1])
    assert reasons == sorted(["key_exists", "status_not_initial", "live_duplicate", "unknown_assertion", "terminal", "planned", "no_new_evidence", "confidence_lowered", "unknown_other", "already_closed", "not_active"])
    assert ("supersede", None, "a", 4, "SUPERSEDED", None, 0.5, True, "a2") in got and ("supersede", None, "a2", 1, "ACTIVE", None, 0.6, False, None) in got
    assert {x[2:6] for x in got if x[0] == "contradict" and x[2]} == {("a", 4, "CONTRADICTED", "CONFLICTED"), ("b", 3, "CONTRADICTED", "CONFLICTED")}


def test_decisions_keep_their_invariants(spark):
    rows = spark.createDataFrame([(1, 0.9, 1, "p"), (2, 0.4, 1, "p"), (3, 0.9, 0, "p"), (4, 0.9, 1, None), (5, None, 1, "p")], "id long, confidence double, n_evidence int, slot string")
    out = decision.decided(rows, [("x", "WARN", "low", F.col("confidence") < 0.5), ("x", "INFO", "seen", F.lit(True))], ["slot"])
    assert {r.id: (r.decision, r.reasons) for r in out.collect()} == {1: ("ACCEPT", "seen"), 2: ("REVIEW", "invariant"), 3: ("REVIEW", "invariant"), 4: ("REVIEW", "invariant"), 5: ("REVIEW", "invariant")}


def test_all_ways_to_say_it_have_one_key(spark):
    profile = spark.createDataFrame([("MAKES", False, "MADE_BY"), ("MADE_BY", False, "MAKES"), ("NEAR", True, None)], "predicate string, symmetric boolean, inverse_of string")
    said = [("a", "b", "MAKES", "DIRECT"), ("b", "a", "MADE_BY", "DIRECT"), ("b", "a", "MAKES", "INVERSE"), ("a", "b", "MADE_BY", "INVERSE"), ("a", "b", "NEAR", "DIRECT"), ("b", "a", "NEAR", "DIRECT"), ("a", "b", "OTHER", "INVERSE")]
    got = [r.canonical_key for r in decision.canonical(spark.createDataFrame(said, "subject string, object string, predicate string, direction string"), profile).collect()]
    assert sorted(got) == ["a|NEAR|b"] * 2 + ["b|MADE_BY|a"] * 4 + ["b|OTHER|a"]


def test_markdown_blocks(spark):
    text = "# One\npara\npara\n\n- a\n- b\n```\n# no heading\n\n```\n| x |\n> q\n## Two\n## Three\nlast"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "\n \n")], "doc_id long, text string")
    got = sorted((r.doc_id, r.first_line, r.kind, r.lines, r.section) for r in markdown.blocks(docs).collect())
    assert got == [(1, 0, "heading", 1, "One"), (1, 1, "paragraph", 2, "One"), (1, 4, "list", 2, "One"), (1, 6, "code", 4, "One"), (1, 10, "table", 1, "One"), (1, 11, "quote", 1, "One"), (1, 12, "heading", 1, "Two"), (1, 13, "heading", 1, "Three"), (1, 14, "paragraph", 1, "Three")]


def test_scoped_visibility_denies_by_default(spark):
    rows = [("n", "public", "w", None, None, 1, []), ("n", "public", "w", "game", None, 1, []), ("n", "public", "w", "game", "g2", 1, []), ("n", "public", "w", "game", "g1", None, []), ("n", "secret", "w", "game", "g1", 1, ["hero"]), ("n", "public", "w", "game", "g1", 99, []), ("n", "public", "w", "lore", "g1", 1, []), ("n", "public", "w", "lore", None, None, []), ("n", "public", "w", "game", "g1", 1, None)]
    frame = spark.createDataFrame(rows, "node_id string, visibility string, workspace string, scope string, game_id string, known_from int, known_by array<string>")
    viewer = policy.Viewer(("w",), games=("g1",), character="hero", max_session=5)
    got = [r.reason for r in frame.select(policy.scoped_reason(viewer).alias("reason")).collect()]
    assert got == ["scope_invalid", "game_blank", "game_not_allowed", "known_from_missing", "visible", "future_session", "scope_contradiction", "lore_not_allowed", "known_by_invalid"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_graph_components_equal_union_find(spark):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect():
        a, b = sorted((find(r.l_suppkey), find(r.l_partkey + 1_000_000_000)))
        root[b] = a
    got = {r.node: r.root for r in catalog.queries()["graph_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in root}


def test_cluster_scores_equal_pairs(spark):
    from itertools import combinations

    from ledgerloom.operators import joins

    items = [(k % 3, k % 4) for k in range(20)] + [(9, 9), (8, 8), (8, 7)]
    pairs = lambda i: {(a, b) for a, b in combinations(range(len(items)), 2) if items[a][i] == items[b][i]}
    gold, predicted = pairs(0), pairs(1)
    r = joins.cluster_scores(spark.createDataFrame(items, "gold int, predicted int")).first()
    assert (r["both"], r["in_gold"], r["in_predicted"]) == (len(gold & predicted), len(gold), len(predicted))
    assert r["precision"] == round(len(gold & predicted) / len(predicted), 6)
    assert joins.cluster_scores(spark.createDataFrame([], "gold int, predicted int")).first()["f1"] is None


def test_span_pairs_lose_none_at_the_borders_of_bins(spark):
    from ledgerloom.operators import joins

    gold = [(1, k, s, s + n) for k, (s, n) in enumerate([(0, 10), (9, 10), (10, 1), (19, 10), (5, 9), (-3, 10)])]
    predicted = [(1, 100 + s, s, s + n) for s, n in [(0, 10), (8, 3), (10, 10), (18, 2), (28, 1), (-5, 3)]] + [(2, 1, 0, 10)]
    schema = "key int, id int, start long, end long"
    got = {(r.gold_id, r.pred_id) for r in joins.span_pairs(spark.createDataFrame(gold, schema), spark.createDataFrame(predicted, schema), 10).collect()}
    assert got == {(g[1], p[1]) for g in gold for p in predicted if g[0] == p[0] and g[2] < p[3] and p[2] < g[3]}


def test_visible_facts_and_memory(spark):
    from ledgerloom.operators import joins

    facts = spark.createDataFrame([(1, None, None), (2, None, None), (3, "a", 1), (4, "b", 2), (5, "a", None)], "fact_id int, scope string, overrides int")
    assert sorted(r.fact_id for r in joins.visible_facts(facts, "a").collect()) == [2, 3, 5]
    memory = spark.createDataFrame([("w", "s", "x", 1, 0.5, 1), ("w", "s", "x", 2, 0.5, 2), ("w", None, "x", 3, 0.9, 1), ("w", None, "y", 4, 0.1, 1)], "workspace string, scope string, surface string, entity_id int, confidence double, at int")
    mentions = spark.createDataFrame([(1, "w", "s", "x"), (2, "w", "t", "x"), (3, "w", None, "y"), (4, "v", "s", "x")], "mention_id int, workspace string, scope string, surface string")
    got = {r.mention_id: (r.entity_id, r.source) for r in joins.remembered(mentions, memory).collect()}
    assert got == {1: (2, "own"), 2: (3, "shared"), 3: (4, "shared"), 4: (None, "none")}
