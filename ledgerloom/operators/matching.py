"""One-to-one matching of the best candidates first, in rounds that gather no key, and what rests on it."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.scores import interval_iou
from ledgerloom.operators.folds import folded
from ledgerloom.session import staged


def best_first(candidates: DataFrame, left: str, right: str, *order: Column) -> DataFrame:
    """The rows of candidates that a walk from the best to the worst would take, each left and right once.

    order: what makes a candidate better (smaller first); ties go by left, then right. A pair that is the best of both its
    sides would be taken by the walk whatever comes before, so each round takes all these and drops what they exclude,
    until nothing is left: the result is that of the walk. A round is two aggregations and three joins by the sides' ids; its
    candidates are written to the shared folder. There are as many rounds as the longest chain of candidates of which each
    waits for the next better one. Candidates without a left or a right are dropped, of repeated ones the best counts.
    """
    rank = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r"))
    rows = candidates.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("__rank", rank)
    rows, taken = staged(rows, "candidates"), None
    while True:
        first = rows.groupBy(left).agg(F.min("__rank").alias("__rank"))
        second = rows.groupBy(right).agg(F.min("__rank").alias("__rank"))
        both = staged(rows.join(first, [left, "__rank"], "left_semi").join(second, [right, "__rank"], "left_semi").dropDuplicates([left]), "matched")
        taken = both if taken is None else taken.unionByName(both)
        rest = rows.join(both.select(left), left, "left_anti").join(both.select(right), right, "left_anti")
        rows = staged(rest, "candidates")
        if rows.isEmpty():
            return taken.drop("__rank").select(*candidates.columns)


#: Widths of a class of length in a bin: wider bins repeat fewer spans and compare more.
WIDE = 8
#: Places of a block of a key's spans that is walked at once.
BLOCK = 1 << 20


def near_spans(gold: DataFrame, predicted: DataFrame, least: float) -> DataFrame:
    """key, gold_id, pred_id, iou, g0, p0 and p1 of spans (key, id, start, end) whose overlap by their union is `least` (a half or more).

    Such spans' lengths differ by no more than a factor of two, so spans meet in bins of WIDE times the width of their class of
    length: a span of any length meets its neighbours of about its own length only.
    """
    length = F.col("end") - F.col("start")
    of = lambda c: F.floor(F.log2(length.cast("double")) + 1e-12).cast("int") + c
    width = F.pow(F.lit(2), F.col("class") + 1).cast("long")
    g = gold.filter("end > start").select("key", F.col("id").alias("gold_id"), F.col("start").alias("g0"), F.col("end").alias("g1"), F.explode(F.array(of(-1), of(0), of(1))).alias("class")).filter("class >= 0")
    g = g.select("*", F.explode(F.sequence(F.floor((F.col("g0") - width) / (WIDE * width)), F.floor(F.col("g1") / (WIDE * width)))).alias("bin"))
    p = predicted.filter("end > start").select("key", F.col("id").alias("pred_id"), F.col("start").alias("p0"), F.col("end").alias("p1"), of(0).alias("class"))
    p = p.withColumn("bin", F.floor(F.col("p0") / (WIDE * width)))
    both = g.join(p, ["key", "class", "bin"]).filter("g0 < p1 AND p0 < g1")
    return both.select("key", "gold_id", "pred_id", interval_iou(F.col("g0"), F.col("g1"), F.col("p0"), F.col("p1")).alias("iou"), "g0", "p0", "p1").filter(F.col("iou") >= least)


def match_spans(gold: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """key, gold_id, pred_id, iou of spans (key, id, start, end) matched one to one by falling overlap, then ids. Ids are
    unique; empty spans match nothing.

    Candidates lie in the block of their gold span. Where all candidates of a predicted span lie in one block too, as its
    place tells, a walk through the block from the best to the worst takes what the whole walk would. What meets a predicted span
    that may have candidates elsewhere, or a candidate that waits for such a one, is left to best_first.
    """
    block = lambda c: F.floor(c / BLOCK)
    near = near_spans(gold, predicted, least).filter("gold_id IS NOT NULL AND pred_id IS NOT NULL")
    apart = (block(F.col("p0") - 2 * (F.col("p1") - F.col("p0"))) != block(F.col("g0"))) | (block(F.col("p1")) != block(F.col("g0")))
    rows = near.select("key", block(F.col("g0")).alias("block"), (-F.col("iou")).alias("order"), "gold_id", "pred_id", apart.alias("waits"))

    def step(state: tuple[set, set], row: dict) -> tuple[tuple[set, set], list]:
        used, waiting = state
        ends = {(0, row["gold_id"]), (1, row["pred_id"])}
        if not used.isdisjoint(ends):
            return state, []
        waits = row["waits"] or not waiting.isdisjoint(ends)
        (waiting if waits else used).update(ends)
        return state, [(row["key"], row["gold_id"], row["pred_id"], -row["order"], waits)]

    of = lambda c: near.schema[c].dataType.simpleString()
    schema = f"key {of('key')}, gold_id {of('gold_id')}, pred_id {of('pred_id')}, iou double, waits boolean"
    walked = staged(folded(rows, ["key", "block"], ["order", "gold_id", "pred_id"], lambda: (set(), set()), step, schema), "walked")
    return walked.filter("NOT waits").drop("waits").unionByName(best_first(walked.filter("waits").drop("waits"), "gold_id", "pred_id", -F.col("iou")))


def align_clusters(items: DataFrame, pinned: DataFrame) -> DataFrame:
    """predicted, gold and n (common items) of predicted clusters matched to one gold cluster each: items (gold, predicted).

    A predicted cluster whose name is in pinned (name) and is a gold cluster's is that one; the others go by the number of
    common items, then by name. Items without either cluster count for nothing.
    """
    pairs = items.groupBy("predicted", "gold").agg(F.count("*").alias("n")).filter("predicted IS NOT NULL AND gold IS NOT NULL")
    fixed = items.select(F.col("predicted").alias("name")).distinct().join(pinned.select("name").distinct(), "name", "left_semi")
    fixed = staged(fixed.join(items.select(F.col("gold").alias("name")).distinct(), "name", "left_semi"), "pinned")
    free = pairs.join(fixed, pairs["predicted"] == fixed["name"], "left_anti").join(fixed, pairs["gold"] == fixed["name"], "left_anti")
    same = pairs.filter("predicted = gold").withColumnRenamed("predicted", "name").select("name", "n")
    own = fixed.join(same, "name", "left").select(F.col("name").alias("predicted"), F.col("name").alias("gold"), F.coalesce("n", F.lit(0)).alias("n"))
    return own.union(best_first(free, "predicted", "gold", -F.col("n")).select("predicted", "gold", "n"))


def match_relations(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """source, gold_id, pred_id, predicate_ok and direction_ok of relations (source, id, a, b, predicate, direction): in the
    order of their ids, gold relations take the best prediction left of their source and unordered pair: the right
    predicate first, then the right direction, then by id.

    Gold relations go by id, so each finds what those before it left: a source's pair is walked once, its predictions first, which
    are held by predicate and direction. No gold relation is joined with a prediction. An id belongs to one source and pair; rows
    without an id, a source or both ends are dropped, and of rows with the same id each can be the one that is matched.
    """
    key = ["source", "x", "y"]
    ends = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
    side = lambda rows, n: rows.filter("id IS NOT NULL AND source IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").select("source", *ends, F.lit(n).alias("side"), "id", "predicate", "direction")

    def step(state: tuple[dict, set, list], row: dict) -> tuple[tuple[dict, set, list], list]:
        left, used, waiting = state
        if row["side"] == 0:
            left.setdefault((row["predicate"], row["direction"]), deque()).append(row["id"])
            return state, []
        found = matched(state, (row["source"],)) if waiting and waiting[-1]["id"] != row["id"] else []
        waiting.append(row)
        return state, found

    def matched(state: tuple[dict, set, list], key: tuple) -> list:
        left, used, waiting = state
        best = None
        for kind, ids in left.items():
            while ids and ids[0] in used:
                ids.popleft()
            for row in waiting if ids else ():
                rank = (kind[0] != row["predicate"], kind[1] != row["direction"], ids[0])
                best = rank if best is None or rank < best else best
        found = []
        if best:
            used.add(best[2])
            found.append((key[0], waiting[0]["id"], best[2], not best[0], not best[1]))
        waiting.clear()
        return found

    of = lambda c: gold.schema[c].dataType.simpleString()
    schema = f"source {of('source')}, gold_id {of('id')}, pred_id {predicted.schema['id'].dataType.simpleString()}, predicate_ok boolean, direction_ok boolean"
    rows = side(gold, 1).unionByName(side(predicted, 0))
    return folded(rows, key, ["side", "id"], lambda: ({}, set(), []), step, schema, lambda key, state: matched(state, key) if state[2] else [])
