"""Joins of claims, fragments, spans and reviews, each keyed or counted first so that no key's rows are paired with one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.scores import first_that, f1, interval_iou, precision, recall
from ledgerloom.session import partitions, staged


def literal_evidence(fragments: DataFrame, texts: DataFrame) -> DataFrame:
    """fragments (fragment_id, text_id, asset, start, end, literal) with status: whether their text (text_id, asset, text)
    holds the literal at its place."""
    t = texts.select("text_id", F.col("asset").alias("own_asset"), "text")
    slice_ = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    status = first_that(
        (F.col("text").isNull(), "unknown_text"), (~F.col("asset").eqNullSafe(F.col("own_asset")), "foreign_asset"), ((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("text")), "out_of_bounds"),
        (slice_ != F.col("literal"), "not_literal"), otherwise="verified",
    )
    return fragments.join(t, "text_id", "left").withColumn("status", status).select(*fragments.columns, "status")


def visible_facts(facts: DataFrame, scope: Column | str) -> DataFrame:
    """Facts (fact_id, scope: null for shared ones, overrides: a fact_id or null) seen from a scope: its own, and the shared
    ones that none of its own overrides."""
    own = facts.filter(F.col("scope") == scope)
    shared = facts.filter(F.col("scope").isNull()).join(own.filter("overrides IS NOT NULL").select(F.col("overrides").alias("fact_id")).distinct(), "fact_id", "left_anti")
    return own.unionByName(shared.select(*own.columns))


def batch_conflicts(claims: DataFrame) -> DataFrame:
    """claims (claim_id, canonical_key, negated) with finding and other: the earliest claim of the batch that says the
    opposite (contradiction), else the earliest that says the same before (duplicate). Each key's earliest claims are found
    by aggregation, so the pairs of a key are never built."""
    n = F.col("negated")
    first = claims.groupBy("canonical_key").agg(F.min(F.when(n, F.col("claim_id"))).alias("first_no"), F.min(F.when(~n, F.col("claim_id"))).alias("first_yes"))
    rows = claims.join(first, "canonical_key")
    opposite, same = F.when(n, F.col("first_yes")).otherwise(F.col("first_no")), F.when(n, F.col("first_no")).otherwise(F.col("first_yes"))
    finding = first_that((opposite.isNotNull(), "contradiction"), (same < F.col("claim_id"), "duplicate"), otherwise="alone")
    return rows.select(*claims.columns, finding.alias("finding"), first_that((opposite.isNotNull(), opposite), (same < F.col("claim_id"), same), otherwise=None).alias("other"))


def span_pairs(gold: DataFrame, predicted: DataFrame, longest: int) -> DataFrame:
    """key, gold_id, pred_id and iou of spans (key, id, start, end), no longer than so, that overlap.

    Spans meet in bins as long as the longest span: a gold span in its own bin and the two beside it, a predicted one in
    its own, so only neighbours are compared, however many spans a key has.
    """
    bin_ = F.floor(F.col("start") / longest)
    g = gold.select("key", F.col("id").alias("gold_id"), F.col("start").alias("g0"), F.col("end").alias("g1"), F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"))
    p = predicted.select("key", F.col("id").alias("pred_id"), F.col("start").alias("p0"), F.col("end").alias("p1"), bin_.alias("bin"))
    both = g.join(p, ["key", "bin"]).filter("g0 < p1 AND p0 < g1")
    return both.select("key", "gold_id", "pred_id", interval_iou(F.col("g0"), F.col("g1"), F.col("p0"), F.col("p1")).alias("iou"), ((F.col("g0") <= F.col("p0")) & (F.col("p1") <= F.col("g1"))).alias("contained"))


def hybrid(rules: DataFrame, models: DataFrame, least_model: float, least_rule: float) -> DataFrame:
    """name, kind, outcome and confidence of the candidates (name, kind, confidence) of two extractors: found by both, or by
    one alone and sure enough, or dropped. Each extractor's candidates are folded to the best first."""
    a = rules.groupBy("name", "kind").agg(F.max("confidence").alias("ca"))
    b = models.groupBy("name", "kind").agg(F.max("confidence").alias("cb"))
    ca, cb = F.col("ca"), F.col("cb")
    outcome = first_that((ca.isNotNull() & cb.isNotNull(), "both"), (cb >= least_model, "model_only"), (cb.isNotNull(), "model_dropped"), (ca >= least_rule, "rule_only"), otherwise="rule_dropped")
    return a.join(b, ["name", "kind"], "full").select("name", "kind", outcome.alias("outcome"), F.greatest(ca, cb).alias("confidence"))


def remembered(mentions: DataFrame, memory: DataFrame) -> DataFrame:
    """mentions (mention_id, workspace, scope, surface) with the entity that the memory (workspace, scope: null for shared,
    surface, entity_id, confidence, at) holds for the surface: of its own scope, else shared; the surest, the later of
    equals. The memory is folded to one entity a key before the join."""
    best = memory.groupBy("workspace", "scope", "surface").agg(F.max_by("entity_id", F.struct("confidence", "at")).alias("entity_id"))
    own = best.filter("scope IS NOT NULL").withColumnRenamed("entity_id", "own_entity")
    shared = best.filter("scope IS NULL").drop("scope").withColumnRenamed("entity_id", "shared_entity")
    rows = mentions.join(own, ["workspace", "scope", "surface"], "left").join(shared, ["workspace", "surface"], "left")
    source = first_that((F.col("own_entity").isNotNull(), "own"), (F.col("shared_entity").isNotNull(), "shared"), otherwise="none")
    return rows.select("mention_id", F.coalesce("own_entity", "shared_entity").alias("entity_id"), source.alias("source"))


def glossary_tiers(mentions: DataFrame, terms: DataFrame) -> DataFrame:
    """mention_id, term, tier and score of the best tier by which a mention's folded surface names a term (term, forms:
    array of (form, tier, score))."""
    forms = terms.select("term", F.explode("forms").alias("f")).select("term", "f.form", "f.tier", "f.score")
    pairs = mentions.join(forms, mentions["surface"] == forms["form"])
    return pairs.groupBy("mention_id").agg(F.min(F.struct((-F.col("score")).alias("least"), "term", "tier", "score")).alias("b")).select("mention_id", "b.term", "b.tier", "b.score")


# ---- scores of what joins align

def cluster_scores(items: DataFrame) -> DataFrame:
    """Pairs of items (gold, predicted: their clusters) that are together in gold, in the prediction and in both, with
    precision, recall and f1. Counted from cluster sizes: no pair is built, whatever the size of a cluster."""
    pairs = lambda by: items.groupBy(*by).count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).cast("long").alias("n"))
    one = pairs(["gold", "predicted"]).select(F.col("n").alias("both")).join(F.broadcast(pairs(["gold"]).select(F.col("n").alias("in_gold")))).join(F.broadcast(pairs(["predicted"]).select(F.col("n").alias("in_predicted"))))
    tp, fp, fn = F.col("both"), F.col("in_predicted") - F.col("both"), F.col("in_gold") - F.col("both")
    return one.select("both", "in_gold", "in_predicted", precision(tp, fp).alias("precision"), recall(tp, fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def compared(samples: DataFrame, k: float = 3.0) -> DataFrame:
    """name, base, other, effect and verdict of samples (name, side: base or other, value): a change counts from k combined
    median absolute deviations on."""
    mid = samples.groupBy("name", "side").agg(F.median("value").alias("mid"))
    spread = samples.join(F.broadcast(mid), ["name", "side"]).groupBy("name", "side").agg(F.first("mid").alias("mid"), F.median(F.abs(F.col("value") - F.col("mid"))).alias("mad"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    rows = spread.groupBy("name").agg(of("base", "mid").alias("base"), of("other", "mid").alias("other"), (of("base", "mad") + of("other", "mad")).alias("noise"))
    effect = F.col("other") - F.col("base")
    verdict = first_that((F.abs(effect) <= k * F.col("noise"), "same"), (effect > 0, "slower"), otherwise="faster")
    return rows.select("name", F.round("base", 6).alias("base"), F.round("other", 6).alias("other"), F.round(effect, 6).alias("effect"), verdict.alias("verdict"))


def placed(rows: DataFrame, count: int, by: list[Column], keep: list[str], name: str) -> DataFrame:
    """Columns of rows (about count of them) with place, from 1 in an order: rows are dealt by ranges of the order, sorted and
    counted within their range, written, and moved up by the ranges before."""
    # The id of a row is its range's number and, in the lower 33 bits, its place there.
    number = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(partitions(rows.sparkSession, count), *by).sortWithinPartitions(*by).withColumn("number", number)
    ranges = staged(ranges.select(*keep, F.shiftright("number", 33).alias("range"), F.col("number").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), name)
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # as many rows as ranges
    before = staged(before.coalesce(1), f"{name}-before")  # every reader of the places needs them
    return ranges.join(F.broadcast(before), "range").select(*keep, (F.col("at") + F.col("before") + 1).alias("place"))


def priority(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (decision, disagree, confidence, id) with place: by decision, those in disagreement first, unknown confidence
    first, then the least sure. Rows are dealt by ranges of that order, sorted and counted within their range and moved up by
    the ranges before, so no task sorts all or a whole decision."""
    ranks = F.create_map(*[F.lit(x) for i, d in enumerate(order) for x in (d, i)])
    rows = rows.withColumn("rank", F.coalesce(F.try_element_at(ranks, F.col("decision")), F.lit(len(order))))
    rows = staged(rows.select("id", "decision", "disagree", "confidence", "rank"), "reviews")
    by = [F.col("rank"), F.col("disagree").desc(), F.col("confidence").asc_nulls_first(), F.col("id")]
    return placed(rows, rows.count(), by, ["id", "decision"], "ranges")
