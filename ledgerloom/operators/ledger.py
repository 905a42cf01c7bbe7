"""The bitemporal append-only ledger as tables: versions, views in time, chains, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.scores import first_that, valid_at

# Legal moves between the states of an assertion: rule data.
TRANSITIONS = [
    ("PLANNED", "ACTIVE"), ("PLANNED", "RETRACTED"), ("ACTIVE", "ENDED"), ("ACTIVE", "SUPERSEDED"), ("ACTIVE", "CONTRADICTED"), ("ACTIVE", "RETRACTED"),
    ("ENDED", "SUPERSEDED"), ("ENDED", "RETRACTED"), ("CONTRADICTED", "ACTIVE"), ("CONTRADICTED", "SUPERSEDED"), ("CONTRADICTED", "RETRACTED"),
]
TERMINAL = ["SUPERSEDED", "RETRACTED"]


def entries(events: DataFrame) -> DataFrame:
    """Events as ledger entries: an assertion is what a user does by type, each event a version of it."""
    status = first_that((F.col("value") < 5, "PLANNED"), (F.col("value") < 40, "ACTIVE"), (F.col("value") < 60, "CONTRADICTED"), (F.col("value") < 80, "ENDED"), (F.col("value") < 90, "SUPERSEDED"), otherwise="RETRACTED")
    return events.select(
        F.col("event_id").alias("seq"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("assertion_id"), F.col("user_id").alias("subject"),
        F.col("event_type").alias("predicate"), F.col("ts").alias("recorded_at"), status.alias("status"), F.round(F.least(F.lit(1.0), F.col("value") / 100), 6).alias("confidence"),
    )


def by_version(partition: str = "assertion_id"):
    return Window.partitionBy(partition).orderBy("recorded_at", "seq")


def versions(rows: DataFrame) -> DataFrame:
    """Entries with revision, and the half-open interval [valid_from, valid_to) until the next version."""
    w = by_version()
    return rows.withColumn("revision", F.row_number().over(w).cast("long")).withColumn("valid_from", F.col("recorded_at")).withColumn("valid_to", F.lead("recorded_at").over(w))


def latest(rows: DataFrame) -> DataFrame:
    """The last entry of each assertion, one aggregation without a sort of the whole history."""
    columns = [c for c in rows.columns if c != "assertion_id"]
    best = rows.groupBy("assertion_id").agg(F.max_by(F.struct(*columns), F.struct("recorded_at", "seq")).alias("e"))
    return best.select("assertion_id", "e.*")


def as_of(rows: DataFrame, instant) -> DataFrame:
    """What the ledger said at an instant of transaction time."""
    return latest(rows.filter(F.col("recorded_at") <= instant))


def live(rows: DataFrame) -> DataFrame:
    """Assertions that still count; contradicted ones do."""
    return rows.filter(~F.col("status").isin(TERMINAL))


def valid(rows: DataFrame, instant) -> DataFrame:
    return rows.filter(valid_at(F.col("valid_from"), F.col("valid_to"), instant))


def transitions(rows: DataFrame) -> DataFrame:
    """assertion_id, revision, move and legal of each step from version to version; staying in a state is legal."""
    w = by_version()
    steps = rows.withColumn("before", F.lag("status").over(w)).withColumn("revision", F.row_number().over(w).cast("long")).filter("before IS NOT NULL")
    legal = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    move = F.concat_ws(">", "before", "status")
    return steps.select("assertion_id", "revision", move.alias("move"), ((F.col("before") == F.col("status")) | F.array_contains(legal, move)).alias("legal"))


def chained(rows: DataFrame) -> DataFrame:
    """Entries with their own hash and the hash of the one before in the same assertion: what a verifier recomputes."""
    own = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "assertion_id", "status", F.col("confidence").cast("string")), 256)
    w = by_version()
    return rows.withColumn("entry_hash", own).withColumn("prev_hash", F.coalesce(F.lag("entry_hash").over(w), F.lit("genesis")))


def broken_links(rows: DataFrame) -> DataFrame:
    """Entries (seq, assertion_id, recorded_at, entry_hash, prev_hash) that do not follow the one before."""
    w = by_version()
    return rows.withColumn("want", F.coalesce(F.lag("entry_hash").over(w), F.lit("genesis"))).filter("want <> prev_hash").drop("want")


def digest(rows: DataFrame) -> DataFrame:
    """subject, version and state_hash: how far each subject's assertions have come and a hash of what they say."""
    each = rows.groupBy("subject").agg(F.count("*").alias("version"), F.array_sort(F.collect_list(F.concat_ws("=", "assertion_id", "status"))).alias("facts"))
    return each.select("subject", "version", F.sha2(F.array_join("facts", ","), 256).alias("state_hash"))


def contradictions(rows: DataFrame) -> DataFrame:
    """Pairs of assertions of a subject that are live, of different predicates and more than half apart in confidence."""
    a = rows.select("subject", F.col("assertion_id").alias("a"), F.col("confidence").alias("ca"))
    b = rows.select("subject", F.col("assertion_id").alias("b"), F.col("confidence").alias("cb"))
    return a.join(b, "subject").filter((F.col("a") < F.col("b")) & (F.abs(F.col("ca") - F.col("cb")) > 0.5)).select("subject", "a", "b")


def gaps(rows: DataFrame, minutes: int) -> DataFrame:
    """subject, sessions and gaps longer than so many minutes between successive entries."""
    w = Window.partitionBy("subject").orderBy("recorded_at", "seq")
    before = F.lag("recorded_at").over(w)
    wide = before.isNotNull() & (F.col("recorded_at") > before + F.expr(f"INTERVAL {minutes} MINUTES"))
    return rows.withColumn("wide", wide).groupBy("subject").agg((F.count_if("wide") + 1).alias("sessions"), F.count_if("wide").alias("gaps"))
