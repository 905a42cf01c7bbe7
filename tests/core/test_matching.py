"""Best-first matching against a walk, spans of all lengths, islands, and reconciled proposals."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import matching, merging


def walked(rows):
    left, right, out = set(), set(), set()
    for score, a, b in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.add((score, a, b))
    return out


def test_best_first_equals_a_walk(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 4), r.randint(0, 30), r.randint(0, 30)) for _ in range(300)]
    rows += [(k, 100 + k // 2, 200 + (k + 1) // 2) for k in range(12)]  # a chain: each waits for the next
    rows += rows[:5] + [(9, None, 1), (9, 1, None)]
    frame = spark.createDataFrame(rows, "score int, a int, b int")
    got = {tuple(x) for x in matching.best_first(frame, "a", "b", -F.col("score")).collect()}
    assert got == walked([x for x in rows if None not in x])
    assert matching.best_first(frame.limit(0), "a", "b", -F.col("score")).count() == 0


def test_spans_of_all_lengths(spark):
    r = random.Random(2)
    span = lambda k: ("t", k, s := r.randint(-50, 400), s + int(2 ** r.uniform(0, 9)))
    gold, predicted = [span(k) for k in range(120)], [span(k) for k in range(120)] + [("t", 900, 5, 5), ("u", 901, 0, 9)]
    of = lambda rows: spark.createDataFrame(rows, "key string, id int, start int, end int")
    iou = lambda g, p: max(0, min(g[3], p[3]) - max(g[2], p[2])) / (max(g[3], p[3]) - min(g[2], p[2]))
    near = {(g[1], p[1]) for g in gold for p in predicted if g[0] == p[0] and p[3] > p[2] and iou(g, p) >= 0.5}
    assert {(x.gold_id, x.pred_id) for x in matching.near_spans(of(gold), of(predicted), 0.5).collect()} == near and len(near) > 40
    best = walked([(round(iou(g, p), 6), g[1], p[1]) for g in gold for p in predicted if (g[1], p[1]) in near])
    assert {(x.iou, x.gold_id, x.pred_id) for x in matching.match_spans(of(gold), of(predicted)).collect()} == best


def test_islands_nested_touching_and_chained(spark):
    rows = [("a", 0, 10), ("a", 2, 3), ("a", 9, 12), ("a", 12, 14), ("a", 12, 12), ("a", 30, 31), ("a", 30, 31), ("b", 1, 2), ("a", None, 3), (None, 1, 2), ("a", 9, 8)]
    frame = spark.createDataFrame([(*r, k, 0.5) for k, r in enumerate(rows)], "key string, start int, end int, id int, confidence double")
    for width in (1, 7, 1000):
        got = sorted((r.key, r.start, r.end, r.n, r.best) for r in merging.merged_islands(frame, width).collect())
        assert got == [("a", 0, 12, 3, 0), ("a", 12, 14, 2, 3), ("a", 30, 31, 2, 5), ("b", 1, 2, 1, 7)]
        assert [r.n for r in merging.merged_islands(frame, width, touching=True).orderBy("key", "start").collect()] == [5, 2, 1]


MENTIONS = "mention_id string, workspace string, asset string, episode string, basis string, start int, end int, surface string, confidence double, types array<struct<type:string,confidence:double>>, evidence array<string>, coreferents array<string>, family string"
CLAIMS = (
    "claim_id string, workspace string, asset string, episode string, subjects array<string>, objects array<string>, evidence array<string>, phrase string, negated boolean, negation string, status string, "
    "abstained boolean, review boolean, predicates array<struct<predicate:string,confidence:double>>, confidence double, family string"
)


def test_reconciled_proposals(spark):
    of = lambda i, at, surface, conf, types, evidence, near, family: (i, "w", "a", "e", None, at, at + 4, surface, conf, types, evidence, near, family)
    mentions = spark.createDataFrame([
        of("m1", 0, "kael", 0.6, [("Person", 0.6)], ["f2"], ["m3"], "local"), of("m2", 0, "kael", 0.8, [("Person", 0.5), ("Place", 0.8)], ["f1", "f2"], ["m1"], "ollama"),
        of("m3", 9, "he", 0.5, None, None, None, "local"), of("m3", 9, "he", 0.5, None, None, None, "local"),
    ], MENTIONS)
    claim = lambda i, s, o, phrase, family, review=True, conf=0.5, predicate="P", negated=False, abstained=False: (
        i, "w", "a", "e", s, o, ["f1"], phrase, negated, None, "ASSERTED", abstained, review, [(predicate, conf)], conf, family)
    claims = spark.createDataFrame([
        claim("c1", ["m1"], ["m3"], " Knows ", "local"), claim("c2", ["m2"], ["m3"], "knows", "local", conf=0.7), claim("c3", ["m2"], ["m3"], "meets", "ollama", conf=0.4, predicate="Q"),
        claim("c4", ["m3"], ["m1"], "x", "local", review=False), claim("c5", ["m3"], ["m2"], "y", "ollama"), claim("c6", ["m1"], ["m3"], "knows", "local", abstained=True), claim("c7", ["zz"], ["m3"], "k", "local"),
    ], CLAIMS)
    kept, out = merging.reconcile(mentions, claims)
    kept = {r.start: r for r in kept.collect()}
    assert (kept[0].confidence, kept[0].proposals, kept[0].families, kept[0].evidence, kept[0].coreferents) == (0.8, 2, 2, ["f1", "f2"], ["m3"])
    assert [tuple(t) for t in kept[0].types] == [("Place", 0.8), ("Person", 0.6)] and kept[9].mention_id == "m3" and kept[9].types is None
    new = kept[0].mention_id
    found = sorted((tuple(r.subjects), tuple(r.objects), r.family, r.confidence, r.proposals, [tuple(p) for p in r.predicates], r.abstained) for r in out.collect())
    assert new.startswith("mention:") and len(found) == 5
    assert ((new,), ("m3",), "ollama", 0.7, 3, [("P", 0.7), ("Q", 0.4)], False) in found  # c1, c2 and c3: two families, all need a review
    assert ((new,), ("m3",), "local", 0.5, 1, [("P", 0.5)], True) in found and (("zz",), ("m3",), "local", 0.5, 1, [("P", 0.5)], False) in found
    assert sum(f[0] == ("m3",) for f in found) == 2  # c4 may be approved by itself, so c5 leaves it alone
    assert merging.reconcile(mentions.limit(0), claims.limit(0))[1].count() == 0


def test_relations_of_one_pair_are_walked_once(spark, monkeypatch):
    """Against the walk; no gold relation is joined with a prediction, whose product a pair of many relations would make."""
    r = random.Random(9)
    of = lambda n, p: [(1 + k % 2, f"{p}{k:03d}", *r.choice([("x", "y"), ("y", "x")]), r.choice(["P", "Q", None]), r.choice(["AB", "BA"])) for k in range(n)] + [(None, p, "x", "y", "P", "AB"), (1, None, "x", "y", "P", "AB"), (1, p + "9", None, "y", "P", "AB")]
    gold, predicted = of(60, "g"), of(50, "p")
    want, used = [], set()
    for s, i, *_, gp, gd in sorted(g for g in gold if all(g[:4])):
        best = min(((gp != pp, gd != pd, j) for t, j, a, b, pp, pd in predicted if t == s and j and a and j not in used), default=None)
        if best:
            used.add(best[2])
            want.append((s, i, best[2], not best[0], not best[1]))
    schema = "source int, id string, a string, b string, predicate string, direction string"
    monkeypatch.setattr(matching, "best_first", None)
    found = matching.match_relations(*(spark.createDataFrame(x, schema) for x in (gold, predicted)))
    assert sorted(tuple(x) for x in found.collect()) == sorted(want) and len(want) == 50
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
