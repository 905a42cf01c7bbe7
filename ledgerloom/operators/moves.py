"""Moves on the ledger: commands become new versions or refusals, sealed chains, snapshots, projections.

A batch holds one command an assertion at most, so all of it is one join of the commands with the current versions; a
batch is taken as a whole against the state before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.scores import first_that
from ledgerloom.operators.ledger import TERMINAL, by_version

INITIAL = ["PLANNED", "ACTIVE"]
VERSION = "array<struct<assertion_id:string,revision:long,status:string,epistemic:string,confidence:double,closed:boolean,successor:string>>"


def refusal() -> Column:
    """Why a command is refused, null if it is not. Columns: operation, was (status now, null for unknown), held (confidence
    now), closed, new_status, new_confidence, new_evidence (number of fragments not seen before), live_twins (live
    assertions of the same identity), other_was."""
    op, was = F.col("operation"), F.col("was")
    return first_that(
        ((op == "assert") & was.isNotNull(), "key_exists"),
        ((op == "assert") & ~F.col("new_status").isin(INITIAL), "status_not_initial"),
        ((op == "assert") & (F.col("live_twins") > 0), "live_duplicate"),
        (op == "assert", None),
        (was.isNull(), "unknown_assertion"),
        (was.isin(TERMINAL), "terminal"),
        ((op == "confirm") & (was == "PLANNED"), "planned"),
        ((op == "confirm") & (F.col("new_evidence") < 1), "no_new_evidence"),
        ((op == "confirm") & (F.col("new_confidence") < F.col("held")), "confidence_lowered"),
        ((op == "supersede") & (was == "PLANNED"), "planned"),
        ((op == "contradict") & F.col("other_was").isNull(), "unknown_other"),
        ((op == "contradict") & F.col("other_was").isin(TERMINAL), "other_terminal"),
        ((op == "close") & (F.col("closed") | (was == "ENDED")), "already_closed"),
        ((op == "close") & ~was.isin("ACTIVE", "CONTRADICTED"), "not_active"),
        otherwise=None,
    )


def version(key: Column, revision: Column, status: Column, confidence: Column, epistemic: Column | None = None, closed: bool = False, successor: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        key.alias("assertion_id"), revision.cast("long").alias("revision"), status.alias("status"), (epistemic if epistemic is not None else none).alias("epistemic"),
        confidence.alias("confidence"), F.lit(closed).alias("closed"), (successor if successor is not None else none).alias("successor"),
    )


def moved(commands: DataFrame) -> DataFrame:
    """operation, reason and the new version (or null for refused commands) of each command joined with what it is about:
    the columns of refusal(), and assertion_id, revision, other_id, other_revision, other_held, successor_id."""
    key, up, held = F.col("assertion_id"), F.col("revision") + 1, F.col("held")
    conflicted = F.lit("CONFLICTED")
    made = first_that(
        (F.col("operation") == "assert", F.array(version(key, F.lit(1), F.col("new_status"), F.col("new_confidence")))),
        (F.col("operation") == "confirm", F.array(version(key, up, F.col("was"), F.col("new_confidence")))),
        (F.col("operation") == "supersede", F.array(version(key, up, F.lit("SUPERSEDED"), held, closed=True, successor=F.col("successor_id")), version(F.col("successor_id"), F.lit(1), F.lit("ACTIVE"), F.col("new_confidence")))),
        (F.col("operation") == "contradict", F.array(version(key, up, F.lit("CONTRADICTED"), held, conflicted), version(F.col("other_id"), F.col("other_revision") + 1, F.lit("CONTRADICTED"), F.col("other_held"), conflicted))),
        (F.col("operation") == "retract", F.array(version(key, up, F.lit("RETRACTED"), held))),
        (F.col("operation") == "close", F.array(version(key, up, F.lit("ENDED"), held, closed=True))),
        otherwise=F.lit(None).cast(VERSION),
    )
    judged = commands.withColumn("reason", refusal())
    return judged.select("operation", "reason", F.explode_outer(F.when(F.col("reason").isNull(), made)).alias("v")).select("operation", "reason", "v.*")


def state_changed(expected: DataFrame, current: DataFrame) -> DataFrame:
    """assertion_id and finding (missing, revision_changed, status_changed, as_expected) of each expectation (assertion_id,
    want_revision, want_status; a null revision expects that there is none)."""
    now = current.select("assertion_id", F.col("revision").alias("now_revision"), F.col("status").alias("now_status"))
    finding = first_that(
        (F.col("want_revision").isNull() & F.col("now_revision").isNotNull(), "exists"), (F.col("want_revision").isNull(), "as_expected"), (F.col("now_revision").isNull(), "missing"),
        (F.col("now_revision") != F.col("want_revision"), "revision_changed"), (F.col("now_status") != F.col("want_status"), "status_changed"), otherwise="as_expected",
    )
    return expected.join(now, "assertion_id", "left").select("assertion_id", finding.alias("finding"))


# ---- sealed chains

def body() -> Column:
    """All that an entry says, as one text."""
    return F.concat_ws("|", F.col("seq").cast("string"), "assertion_id", "status", F.format_string("%.6f", "confidence"))


def seal_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by assertion and version; only the last hash is kept, so a history of any length will do."""
    key, last = None, ""
    for batch in batches:
        before, own = [], []
        for k, text in zip(batch["assertion_id"], batch["body"]):
            if k != key:
                key, last = k, "genesis"
            before.append(last)
            last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
            own.append(last)
        yield batch[["seq", "assertion_id"]].assign(prev_hash=before, entry_hash=own)


def sealed(rows: DataFrame) -> DataFrame:
    """seq, assertion_id, prev_hash and entry_hash: the hash of an entry's body and the hash before it."""
    dealt = rows.select("assertion_id", "recorded_at", "seq", body().alias("body")).repartition("assertion_id").sortWithinPartitions("assertion_id", "recorded_at", "seq")
    return dealt.mapInPandas(seal_task, "seq long, assertion_id string, prev_hash string, entry_hash string")


def broken(rows: DataFrame) -> DataFrame:
    """seq, assertion_id and fault (altered, unlinked) of stored entries that their stored hashes do not fit."""
    want = F.coalesce(F.lag("entry_hash").over(by_version()), F.lit("genesis"))
    own = F.sha2(F.concat_ws("|", "prev_hash", body()), 256)
    fault = first_that((F.col("prev_hash") != F.col("want"), "unlinked"), (F.col("entry_hash") != own, "altered"), otherwise=None)
    return rows.withColumn("want", want).select("seq", "assertion_id", fault.alias("fault")).filter("fault IS NOT NULL")


# ---- views

def snapshot(rows: DataFrame) -> DataFrame:
    """subject, version (the sum of its assertions' revisions) and hash of its sorted facts."""
    each = rows.groupBy("subject").agg(F.sum("revision").alias("version"), F.array_sort(F.collect_list(F.concat_ws("|", "predicate", "assertion_id", "status"))).alias("facts"))
    return each.select("subject", "version", F.sha2(F.array_join("facts", "\n"), 256).alias("hash"))


def projected(rows: DataFrame, include_negated: bool = False, include_conflicted: bool = False) -> DataFrame:
    """Live assertions (subject, object, predicate, status, negated, confidence) as edges."""
    keep = ~F.col("status").isin([*TERMINAL, "PLANNED"])
    if not include_negated:
        keep &= ~F.col("negated")
    if not include_conflicted:
        keep &= F.col("status") != "CONTRADICTED"
    return rows.filter(keep).select(F.col("subject").alias("src"), F.col("object").alias("dst"), "predicate", "confidence")


def chain_ends(links: DataFrame, staged) -> DataFrame:
    """id, last, steps and cycle of every id in links (id, successor), following successors to the end.

    Pointers are doubled: each round joins what was reached with what is reached from there, so a chain of n links takes
    log2(n) rounds, each written out by staged(). What still moves after more rounds than that lies on or before a cycle.
    """
    reach = staged(links.filter("successor IS NOT NULL").select("id", F.col("successor").alias("last"), F.lit(1).cast("long").alias("steps")))
    rounds = max(1, reach.count()).bit_length() + 1
    for _ in range(rounds):
        on = reach.select(F.col("id").alias("last"), F.col("last").alias("further"), F.col("steps").alias("more"))
        reach = staged(reach.join(on, "last", "left").select("id", F.coalesce("further", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moving")))
        if not reach.filter("moving").limit(1).count():
            break
        reach = reach.drop("moving") if _ + 1 < rounds else reach
    reach = reach.withColumn("moving", F.coalesce("moving", F.lit(False))) if "moving" in reach.columns else reach.withColumn("moving", F.lit(False))
    return reach.select("id", F.when(~F.col("moving"), F.col("last")).alias("last"), F.when(~F.col("moving"), F.col("steps")).alias("steps"), F.col("moving").alias("cycle"))
