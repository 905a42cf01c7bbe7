"""Work that grows with the input: what a task reads is not joined, repeated or walked by a single task."""

import re

from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import assess, joins, lexicon, matching
from ledgerloom.plans import assess_queries, extract_queries, stream_queries, temporal_queries
from ledgerloom.streaming import plan_log

SMALL = "/root/testdata/sf0.001"
LEXICON = "kind string, entry string, type string, confidence double, canonical boolean, surface string"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pairs_carry_their_sentences_and_are_joined_with_no_text(spark):
    assert "Join" not in plan(assess_queries.relation_cues(spark, SMALL)) and "Exchange" not in plan(assess_queries.relation_cues(spark, SMALL))
    said = ["Uno. Ana vive en Roma; aquí. Fin", "Ana y Roma", "😀! Ana va\nRoma. Ana", "Roma", None, "..Ana. Ana", "Ana_Roma Ana"]
    texts = spark.createDataFrame([(k % 6, t) for k, t in enumerate(said)], "text_id long, text string")
    entries = spark.createDataFrame([("entity", n, t, 0.5, True, n) for n, t in (("Ana", "Character"), ("Roma", "Location"))], LEXICON)
    got = lexicon.mention_pairs(texts, entries)
    assert sorted((r.text_id, r.at, r.segment, r.s_start, r.o_end, r.o_type) for r in got.collect()) == [
        (0, 4, " Ana vive en Roma; aquí.", 1, 17, "Location"), (1, 0, "Ana y Roma", 0, 10, "Location"), (2, 2, " Ana va\nRoma.", 1, 12, "Location"), (2, 10, "Roma. Ana", 0, 9, "Character"), (5, 2, "Ana. Ana", 0, 8, "Character"),
    ]
    whole = got.join(texts.withColumnRenamed("text", "whole"), "text_id").filter("text_id > 0")
    places = [F.col(c) + F.col("at") for c in ("s_start", "s_end", "o_start", "o_end")]
    whole = whole.select("text_id", "at", F.col("whole").alias("segment"), *[p.alias(c) for p, c in zip(places, ("s_start", "s_end", "o_start", "o_end"))])
    windows = lambda rows: sorted((r.text_id, r.at, r.window) for r in assess.pair_window(rows.filter("text_id > 0")).collect())
    assert windows(got) == windows(whole)


def test_signals_of_pairs_are_joined_with_no_text(spark):
    got = assess_queries.relation_signals(spark, SMALL)
    assert "Join" not in plan(got) and "Exchange" not in plan(got)


def test_claims_need_only_hits_of_sentences_with_pairs(spark):
    texts = spark.createDataFrame([(1, "Ana está en Roma. Ana en casa. En Roma! En Ana y Roma en Ana; en"), (2, "en en"), (3, None), (4, "Ana en. Roma")], "text_id long, text string")
    named = spark.createDataFrame([(n, n, [], None, 0.5) for n in ("Ana", "Roma")], "entry string, name string, aliases array<string>, type string, confidence double")
    rules = spark.createDataFrame(extract_queries.RULES, extract_queries.RULE_COLUMNS)
    entries = lexicon.entity_lexicon(named).unionByName(lexicon.rule_lexicon(rules))
    every, paired = lexicon.phrase_hits(texts, entries), lexicon.phrase_hits(texts, entries, paired=True)
    claims = lambda hits: sorted(map(str, lexicon.rule_claims(hits, rules).collect()))
    assert claims(every) == claims(paired) and len(claims(paired)) == 2
    assert {(r.text_id, r.sentence) for r in paired.collect()} == {(1, 0), (1, 3)} and paired.count() < every.count()


def test_operations_are_numbered_once_for_all_batches(spark):
    assert "Window" not in plan(stream_queries.plan_entries(spark, SMALL))


def test_plans_are_not_dealt_out_to_be_refused(spark):
    entries = stream_queries.plan_entries(spark, SMALL)
    judged = plan_log.judged(entries, spark.createDataFrame([], plan_log.LOG))
    assert not [keys for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan(judged)) if "plan_id" in keys]


def test_operations_are_numbered_in_ranges_of_their_order(spark, monkeypatch):
    written = {}
    for module in (joins, stream_queries):
        monkeypatch.setattr(module, "staged", lambda frame, name, f=session.staged: written.setdefault(name, plan(frame)) and f(frame, name))
    monkeypatch.setattr(session, "PARTITION_ROWS", 500)
    got = stream_queries.plan_entries(spark, SMALL).groupBy("workspace").agg(F.count("*").alias("n"), F.count_distinct("at").alias("d"), F.min("at").alias("a"), F.max("at").alias("b")).collect()
    assert "Window" not in written["plan-lines"] and "rangepartitioning" in written["plan-lines"]
    assert len(got) == 40 and all(r.n == r.d == r.b and r.a == 1 for r in got)


def test_entries_are_dealt_by_rows(spark, monkeypatch):
    entries, none = stream_queries.plan_entries(spark, SMALL), spark.createDataFrame([], plan_log.LOG)
    rows = lambda frame: sorted(map(str, frame.collect()))
    whole = plan_log.judged(entries, none)
    want, count = rows(whole), entries.count()
    log = session.staged(whole.withColumn("batch", F.lit(0).cast("long")), "log")
    again, ends = rows(plan_log.judged(entries, log)), rows(plan_log.assertions(log))
    for module in (session, plan_log):
        monkeypatch.setattr(module, "PARTITION_ROWS", 500)
    judged = plan_log.judged(entries, none)
    assert re.search(rf"hashpartitioning\(workspace#\d+, op_key#\d+, {-(-count // 500)}\), REPARTITION_BY_NUM", plan(judged)) and rows(judged) == want
    monkeypatch.setattr(plan_log, "FEW", 10)
    assert rows(plan_log.judged(entries, log)) == again and {r.outcome for r in plan_log.judged(entries, log).select("outcome").distinct().collect()} == {"skipped", "refused"}
    assert "Join" not in plan(plan_log.assertions(log)) and plan(plan_log.assertions(log)).count("Exchange hashpartitioning") == 1 and rows(plan_log.assertions(log)) == ends


def test_ends_count_only_behind_the_first_creation(spark):
    made, gone, shut = "CREATE_ASSERTION", "SUPERSEDE_ASSERTION", "CLOSE_VALIDITY"
    said = [("A", 1, gone, "Z"), ("A", 3, made, None), ("A", 4, made, None), ("A", 6, gone, "Y"), ("A", 5, shut, "X"), ("B", 2, shut, None), ("C", 7, made, None), ("C", 8, gone, None), (None, 9, made, None), (None, 10, shut, None), ("D", 11, made, None)]
    log = spark.createDataFrame([("w", "p", n, str(n), op, a, other, f"s{n}", None, n * 10, "applied" if a != "D" else "refused", None, 0) for a, n, op, other in said], plan_log.LOG)
    got = sorted((r.assertion_id or "", r.subject, r.object, r.status, r.valid_from, r.valid_to, r.superseded_by) for r in plan_log.assertions(log).collect())
    assert got == [("", "s9", None, "ACTIVE", 90, None, None), ("A", "s3", None, "ENDED", 30, 50, None), ("C", "s7", None, "SUPERSEDED", 70, 80, None)]


def test_a_table_in_one_file_is_cut_into_phases_by_several_tasks(spark):
    assert assess_queries.transition_phases(spark, SMALL).rdd.getNumPartitions() > 1
    rows = spark.createDataFrame([(1, "Hoy no\nluego; AHORA"), (2, ""), (3, None), (4, "a\x01b después c ahorá"), (5, "ahorar luegos hoy.hoy")], "id int, text string")
    got = [(r.id, r.place, r.phase) for r in assess.phases(rows, assess_queries.TURNS, ["id"]).orderBy("id", "place").collect()]
    assert got == [(1, 0, "Hoy no\n"), (1, 1, "luego"), (1, 2, "AHORA"), (4, 0, "a\x01b"), (4, 1, "después c"), (4, 2, "ahorá"), (5, 0, "ahorar luegos"), (5, 1, "hoy"), (5, 2, "hoy")]


def test_expressions_of_time_are_found_once(spark):
    assert "MapInArrow" not in plan(temporal_queries.temporal_resolutions(spark, SMALL))
    assert temporal_queries.passages(spark, SMALL).rdd.getNumPartitions() > 1


def test_spans_are_walked_in_blocks_with_the_same_matches(spark, monkeypatch):
    spans = lambda a, b: spark.range(400).select((F.col("id") % 2).alias("key"), F.concat(F.lit("s"), "id").alias("id"), (F.col("id") * a % 211).alias("start"), (F.col("id") * a % 211 + 1 + F.col("id") * b % 17).alias("end"))
    gold, predicted = spans(7, 5), spans(11, 3)
    want = sorted(map(tuple, matching.best_first(matching.near_spans(gold, predicted, 0.5), "gold_id", "pred_id", -F.col("iou")).select("key", "gold_id", "pred_id", "iou").collect()))
    rounds = []
    monkeypatch.setattr(matching, "best_first", lambda rows, *a, f=matching.best_first: rounds.append(rows.count()) or f(rows, *a))
    for size in (1 << 20, 64):
        monkeypatch.setattr(matching, "BLOCK", size)
        assert sorted(map(tuple, matching.match_spans(gold.select("*"), predicted, 0.5).collect())) == want
    near = matching.near_spans(gold, predicted, 0.5).count()
    assert rounds[0] < near / 4 and 0 < rounds[1] < near
