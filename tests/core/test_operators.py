"""Small fixtures for operators that SQL does not cover, and edge cases."""

from pyspark.sql import functions as F

from ledgerloom.functions import scores, text as T
from ledgerloom.operators import graph, ingest, intervals, ledger, policy, relations, resolve
from ledgerloom.plans import graph_queries
from ledgerloom.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fold_and_similarity(spark):
    assert one(spark, T.fold(F.lit("  Ñandú--Él! 7 "))) == "nandu el 7"
    assert one(spark, T.fold(F.lit("Škoła ř ﬁn ½ ａ e\u0301 Ⅷ"))) == "sko a r fin 1 2 a e viii"
    assert one(spark, T.similarity(F.lit("Ána Bel"), F.lit("ana bel"))) == 1.0
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


def test_quality_flags(spark):
    assert one(spark, T.quality_flags(F.lit(" \n "))) == ["empty_text"]
    assert one(spark, T.quality_flags(F.lit(None).cast("string"))) == ["empty_text"]
    assert one(spark, T.quality_flags(F.lit("ab\x01 �"))) == ["control_chars", "replacement_chars", "short_text"]
    assert one(spark, T.quality_flags(F.lit("It is so. it IS so! It is so.\nIt is so. And it goes on."))) == []
    assert one(spark, T.quality_flags(F.lit("Yes it is. yes IT is. Yes it is. The end of it."))) == ["repeated_content"]


def test_ratios_are_null_for_nothing(spark):
    assert one(spark, scores.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, scores.f1(F.lit(0), F.lit(0), F.lit(3))) is None
    assert one(spark, scores.valid_at(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1))) is False
    assert one(spark, scores.valid_at(F.lit(1), F.lit(None).cast("int"), F.lit(1))) is True


def test_turn_windows_start_anew_on_role_and_length(spark):
    turns = spark.createDataFrame([(1, 0, "a", "xxx"), (1, 1, "a", "yyy"), (1, 2, "b", None), (1, 3, "b", "zzzzzz")], "conv_id long, turn long, role string, text string")
    got = {(r.window, r.first_turn, r.last_turn, r.n_chars) for r in ingest.turn_windows(turns, 5).collect()}
    assert got == {(1, 0, 0, 3), (2, 1, 1, 3), (3, 2, 2, 0), (4, 3, 3, 6)}


def test_char_chunks_keep_every_character(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, ""), (3, "x" * 25)], "doc_id long, text string")
    got = {}
    for r in ingest.char_chunks(docs, 10).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {1: ["one two ", "three four"], 3: ["x" * 10, "x" * 10, "x" * 5]}


def test_decide_needs_a_margin(spark):
    scored = spark.createDataFrame([(1, 10, 0.95), (1, 11, 0.90), (2, 10, 0.95), (3, 12, 0.3)], "mention_id long, entity_id long, score double")
    assert {(r.mention_id, r.action) for r in resolve.decide(scored).collect()} == {(1, "REVIEW"), (2, "LINK"), (3, "CREATE_NEW")}


def test_resolved_equals_candidates_of_every_pair(spark, tmp_path):
    names = ["red ring", "ring red", "red ring", "hot gear", "hot gear", "red widget", "old", "red ring", "hot plate"]
    part = spark.createDataFrame([(200 * k + 7, x) for k, x in enumerate(names)], "p_partkey long, p_name string")
    part.write.parquet(str(tmp_path / "part.parquet"))
    got = graph_queries.name_resolution_all(spark, str(tmp_path)).collect()
    assert sorted(r.mention_id for r in got) == [200 * k + 7 for k in range(9) if k != 6 or 1207 % 3 != 2]
    entities = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array(F.array_join(F.reverse(F.split("p_name", " ")), " ")).alias("aliases"))
    mentions = spark.createDataFrame([(1, "RED RING"), (2, "red ring"), (3, "hot gears"), (4, "blue"), (5, "old"), (6, "plate hot"), (7, "RED RING"), (8, None)], "mention_id long, surface string")
    want = resolve.decide(resolve.candidates(mentions, entities)).collect()
    assert sorted(map(tuple, resolve.resolved(mentions, entities).collect())) == sorted(map(tuple, want)) and len(want) == 6


def test_broken_chain_is_found(spark):
    rows = spark.createDataFrame([(1, "a", "2024-01-01", "ACTIVE", 0.5), (2, "a", "2024-01-02", "ENDED", 0.5)], "seq long, assertion_id string, recorded_at string, status string, confidence double")
    chain = ledger.chained(rows)
    assert ledger.broken_links(chain).count() == 0
    assert ledger.broken_links(chain.withColumn("prev_hash", F.lit("x"))).count() == 2


def test_policy_fails_closed(spark):
    rows = spark.createDataFrame(
        [("a", None, "w1", None), ("b", "deny", "w1", None), ("c", "public", None, None), ("d", "public", "w1", 5), ("e", "secret", "w1", None), ("f", "PUBLIC ", "w1", None)],
        "node_id string, visibility string, workspace string, revealed_in int",
    )
    why = lambda viewer: {r.node_id: r.reason for r in policy.judged(rows, viewer).collect()}
    assert why(policy.Viewer(("w1",))) == {"a": "visibility_invalid", "b": "deny_absolute", "c": "workspace_invalid", "d": "session_unknown", "e": "secret_not_allowed", "f": "level_allowed"}
    assert why(policy.Viewer(admin=True))["b"] == "deny_absolute"
    assert why(policy.Viewer(("w1",), knows=("e",)))["e"] == "known"


def test_components(spark, tmp_path):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 8), (5, 5)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(links, str(tmp_path)).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}


def test_graph_components_take_every_supplier(spark, tmp_path):
    lines = [(7, 1), (7, 2), (8, 2), (8, 3), (1, 4), (2, 4), (2, 5), (14, 6), (3, 7), (3, 7)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in lines:
        a, b = sorted((root(a), root(b + 1_000_000_000)))
        parent[b] = a
    got = [(r.node, r.root) for r in graph_queries.graph_components(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((x, root(x)) for x in list(parent))


def test_overlaps_come_once(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 10, 20)], "k int, start long, end long")
    b = spark.createDataFrame([(1, 5, 12), (2, 5, 12)], "k int, start long, end long")
    assert intervals.overlaps(a, b, "k", 10).count() == 2


def test_co_mentions_meet_across_cells(spark):
    m = spark.createDataFrame([(1, "a", 3), (1, "b", 4), (1, "c", 9), (1, "a", 8)], "context int, entity string, place long")
    got = {(r.a, r.b, r.distance) for r in relations.co_mentions(m, 4, 9).collect()}
    assert got == {("a", "b", 1), ("a", "c", 1)}


def test_captions_and_adapters(spark, tmp_path):
    (tmp_path / "x.vtt").write_text("WEBVTT\n\n1\n00:01 --> 00:02\n<b>Hello</b>\nHello\nBye\n")
    assert [r.text for r in tables.captions(tables.scan_lines(spark, str(tmp_path / "x.vtt"))).orderBy("line_no").collect()] == ["Hello", "Bye"]
    files = spark.createDataFrame([("a.md", None, None), ("a.md", None, "text/csv"), ("a.md", "pdf", None), ("a", None, None)], "name string, kind string, mime string")
    assert [r.adapter for r in tables.choose_adapter(files).collect()] == ["markdown", "table", "pdf", "unsupported_source_kind"]
