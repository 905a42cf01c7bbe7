"""Candidate relations: pairs that occur together, signals, ensemble, consensus, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.scores import codes, first_that

# Weights of an ensemble's sources, and its thresholds: rule data.
WEIGHTS = {"distance": 0.6, "clause": 0.8, "types": 1.0, "cue": 0.7, "syntax": 1.0, "local": 1.2, "external": 1.4}
MARGIN, PARTIAL, STRONG, DECISIVE = 0.15, 0.45, 0.75, 2


def co_mentions(mentions: DataFrame, most: int, keep: int) -> DataFrame:
    """context, a, b and distance of mentions (context, entity, place) at most so far apart; per context the nearest ones.

    Places are cut into cells as wide as the distance, and a mention meets only those of its own and the next cell, so a
    context with many mentions does not pair all of them.
    """
    cell = F.floor(F.col("place") / most).cast("long")
    left = mentions.select("context", F.col("entity").alias("x"), F.col("place").alias("px"), cell.alias("cell"))
    right = mentions.select("context", F.col("entity").alias("y"), F.col("place").alias("py"), F.explode(F.array(cell, cell - 1)).alias("cell"))
    pairs = left.join(right, ["context", "cell"]).filter((F.col("x") != F.col("y")) & (F.abs(F.col("px") - F.col("py")) <= most))
    pairs = pairs.select("context", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.abs(F.col("px") - F.col("py")).alias("distance"))
    nearest = pairs.groupBy("context", "a", "b").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("context").orderBy("distance", "a", "b")
    return nearest.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= keep).drop("rk")


def ensemble(votes: dict[str, Column]) -> Column:
    """Weighted mean of the votes (-1, 0 or 1) of those sources that do not abstain (0), rounded; 0 if all do."""
    total = sum(F.lit(w) * F.when(votes[k] != 0, 1.0).otherwise(0.0) for k, w in WEIGHTS.items() if k in votes)
    score = sum(F.lit(w) * votes[k] for k, w in WEIGHTS.items() if k in votes)
    return F.round(F.coalesce(F.try_divide(score, total), F.lit(0.0)), 6)


def ensemble_state(score: Column, decisive: Column) -> Column:
    return first_that(
        (decisive < DECISIVE, "INSUFFICIENT"), (F.abs(score) < MARGIN, "UNDECIDED"), (score >= STRONG, "STRONG"), (score >= PARTIAL, "PARTIAL"), (score < 0, "AGAINST"), otherwise="WEAK"
    )


def decision(findings: dict[str, tuple[str, Column]]) -> tuple[Column, Column]:
    """The decision by the worst severity among the findings that hold, and their sorted codes.

    findings: code -> (severity, condition); severities, from worst: invalid, abstain, review, info.
    """
    of = lambda severity: [c for s, c in findings.values() if s == severity]
    any_of = lambda cs: F.coalesce(F.greatest(*[F.coalesce(c, F.lit(False)) for c in cs], F.lit(False)), F.lit(False)) if cs else F.lit(False)
    outcome = first_that((any_of(of("invalid")), "REJECT_INVALID"), (any_of(of("abstain")), "ABSTAIN"), (any_of(of("review")), "REVIEW"), otherwise="ACCEPT")
    return outcome, codes(*[(c, code) for code, (_, c) in findings.items()])


def greedy_by_key(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """The k-th gold row with the k-th prediction of an equal key, both by id: what a greedy matcher inside a key does."""
    nth = lambda frame, name: frame.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(name)))
    return nth(gold, "gold_id").join(nth(predicted, "predicted_id"), [key, "nth"], "full")


def fact_key(a: Column, b: Column, predicate: Column, symmetric: Column) -> Column:
    """Ends in order where the predicate is symmetric, so both orientations are one fact."""
    return F.concat_ws("|", F.when(symmetric, F.least(a, b)).otherwise(a), F.when(symmetric, F.greatest(a, b)).otherwise(b), predicate)
