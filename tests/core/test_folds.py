"""Admission and memory against a plain walk, with nulls, ties and tasks that hold several keys."""

from ledgerloom.operators import folds


def test_a_refused_call_does_not_count(spark, monkeypatch):
    monkeypatch.setattr(folds, "SLICE", 2)
    rows = [("a", 1, 1, 6, "call"), ("a", 2, 2, 6, "call"), ("a", 3, 3, 4, "call"), ("a", 4, 4, 1, "call"), ("a", 5, 5, 4, "refund"), ("a", 6, 6, None, "call"), ("b", 1, 7, 99, "refund"), ("b", 1, 8, 10, "call"), (None, 1, 9, 3, "call"), ("c", 1, 10, 11, "call")]
    frame = spark.createDataFrame(rows, "run string, at int, request_id int, cost int, kind string").repartition(1)
    got = sorted((r.request_id, r.admitted, r.calls, r.cost) for r in folds.admitted(frame, 3, 10).collect())
    assert got == [(1, True, 1, 6), (2, False, 1, 6), (3, True, 2, 10), (4, False, 2, 10), (5, True, 1, 6), (6, True, 2, 7), (7, True, 0, 0), (8, True, 1, 10), (9, True, 1, 3), (10, False, 0, 0)]
    assert all(r.admitted for r in folds.admitted(frame, None, None).collect()) and folds.admitted(frame.limit(0), 1, 1).count() == 0


def test_memory_is_replaced_only_by_the_surer(spark):
    e = lambda at, kind, surface=None, entity=None, sure=None, res=None, w="w", scope=None, action="LINK_EXISTING": (at, str(at), kind, w, scope, surface, entity, res, sure, action)
    rows = [
        e(1, "record", "kael", "E1", 0.5, "r1"), e(2, "record", "kael", "E2", 0.5, "r2"), e(3, "record", "kael", "E1", 0.9, "r3"), e(4, "record", "kael", "E3", 0.6, "r4"), e(5, "record", "mira", "E3", 0.4, "r5"),
        e(6, "record", "kael", "E4", 0.7, "r6", scope="p1"), e(7, "forget_entity", entity="E3"), e(8, "record", "kael", "E2", 0.1, "r7"), e(9, "forget_surface", "kael"), e(10, "record", "", "E9", 1.0), e(11, "record", "zz", None, 1.0),
        e(12, "record", "x", "E1", 0.5, "r8", action="REVIEW"), e(13, "record", "y", "E1", 0.5, "r9"), e(14, "forget_resolution", res="r9"), e(15, "record", "k", "E1", 0.5, "r1", w="v"), e(16, "forget_workspace", w="v"), e(17, "record", "k", "E5", 0.2, "ra", w="v"),
    ]
    events = spark.createDataFrame(rows, "at int, event_id string, kind string, workspace string, scope string, surface string, entity_id string, resolution_id string, confidence double, action string")
    held = folds.memory(events)
    assert sorted((r.workspace, r.scope or "", r.surface, r.entity_id, r.confidence) for r in held.collect()) == [("v", "", "k", "E5", 0.2), ("w", "p1", "kael", "E4", 0.7)]
    early = folds.memory(events.filter("at < 7"))
    assert {(r.scope, r.surface): r.entity_id for r in early.collect()} == {(None, "kael"): "E3", ("p1", "kael"): "E4", (None, "mira"): "E3"}
    mentions = spark.createDataFrame([(1, "w", "p1", "kael"), (2, "w", "p2", "kael"), (3, "w", None, "kael"), (4, "w", None, "none"), (5, None, None, None)], "mention_id int, workspace string, scope string, surface string")
    assert sorted((r.mention_id, r.entity_id, r.source) for r in folds.recalled(mentions, early).collect()) == [(1, "E4", "own"), (2, "E3", "shared"), (3, "E3", "shared"), (4, None, "none"), (5, None, "none")]
    assert folds.memory(events.limit(0)).count() == 0


def test_forgets_come_once_a_group_of_surfaces(spark, monkeypatch):
    schema = "at int, event_id string, kind string, workspace string, scope string, surface string, entity_id string, resolution_id string, confidence double, action string"
    rows = [(k, f"a{k:03d}", "record", "w", None, f"n{k}", f"E{k % 2}", "r", 0.5, "MERGE") for k in range(64)]
    rows += [(100 + k, f"f{k:03d}", ("forget_entity", "forget_resolution", "forget_workspace")[k % 3], "w", None, None, "E1", "q", None, None) for k in range(99)] + [(300, "z", "record", "w", "s", "n1", "E5", "r", 0.1, "MERGE")]
    walked, walk = [], folds.folded
    monkeypatch.setattr(folds, "folded", lambda frame, *rest: walked.append(frame.count()) or walk(frame, *rest))
    events = spark.createDataFrame(rows, schema)
    assert [tuple(r)[:4] for r in folds.memory(events).collect()] == [("w", "s", "n1", "E5")]
    assert walked[0] <= 65 + 99 * -(-65 // folds.TOGETHER) < 65 + 33 * 64
    assert sorted(r.surface for r in folds.memory(events.filter("at = 100 OR at < 100")).collect()) == sorted(f"n{k}" for k in range(0, 64, 2))
