"""Mutation plans over accepted decisions, their admission, idempotent application and rollback; mentions and aliases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.scores import codes, first_that, ratio

# What an operation writes, what undoes that, and the properties that a supersession changes.
WRITES = {"CREATE_ASSERTION": "NODE", "SUPERSEDE_ASSERTION": "PROPERTIES", "PROJECT_RELATION": "RELATIONSHIP"}
UNDOES = {"NODE": "DELETE_NODE", "RELATIONSHIP": "DELETE_RELATIONSHIP", "PROPERTIES": "RESTORE_PROPERTIES"}
SUPERSEDED = ("superseded_by", "status", "valid_to", "reason_code")


def planned(decisions: DataFrame) -> DataFrame:
    """plan_id, place, op, claim_id, canonical_key, predicate, a, b, negated and op_key of accepted decisions.

    decisions: plan_id, claim_id, a, predicate and b (the claim in its canonical orientation), action (ACCEPT, or another,
    which gives nothing), supersedes (a claim or null) and negated (null: false). A claim creates its assertion, then
    supersedes the old one, then projects its relation unless it is negated. canonical_key joins a, predicate and b.
    op_key, a digest, is the same whenever the plan is made again.
    """
    no = F.coalesce("negated", F.lit(False))
    ops = F.array(F.lit("CREATE_ASSERTION"), F.when(F.col("supersedes").isNotNull(), F.lit("SUPERSEDE_ASSERTION")), F.when(~no, F.lit("PROJECT_RELATION")))
    key = F.concat_ws("|", "a", "predicate", "b").alias("canonical_key")
    rows = decisions.filter("action = 'ACCEPT'").select("plan_id", "claim_id", key, "predicate", "a", "b", no.alias("negated"), F.posexplode(ops).alias("place", "op")).filter("op IS NOT NULL")
    return rows.withColumn("op_key", F.sha2(F.concat_ws("|", "plan_id", "claim_id", "place", "op", "canonical_key"), 256))


def inconsistent(ops: DataFrame) -> DataFrame:
    """plan_id, twice and opposed of plans that create an assertion of the same canonical key twice, negated or not, or
    assertions of the same pair and predicate in both orientations.

    Keys are counted and orientations compared by the unordered pair and the predicate, so no two operations meet; ops that
    are dealt by plan_id are not shuffled, only the plans found are.
    """
    made = ops.filter("op = 'CREATE_ASSERTION'")
    twice = made.groupBy("plan_id", "canonical_key").agg((F.count("*") > 1).alias("twice")).filter("twice").select("plan_id", "twice", F.lit(False).alias("opposed"))
    ends = made.filter("a <> b").groupBy("plan_id", "predicate", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    opposed = ends.agg((F.bool_or(F.col("a") < F.col("b")) & F.bool_or(F.col("a") > F.col("b"))).alias("opposed")).filter("opposed").select("plan_id", F.lit(False).alias("twice"), "opposed")
    return twice.union(opposed).groupBy("plan_id").agg(F.bool_or("twice").alias("twice"), F.bool_or("opposed").alias("opposed"))


def refused(**conditions: Column) -> Column:
    """Sorted codes of the conditions that do not surely hold: a null is a refusal."""
    return codes(*[(~F.coalesce(c, F.lit(False)), code) for code, c in conditions.items()])


def simulated(ops: DataFrame, applied: DataFrame, bad_plans: DataFrame) -> DataFrame:
    """ops with outcome: refused (its plan is in bad_plans), skipped (op_key is in applied), repeated (a later row of the
    same op_key) or would_apply. A plan is applied as a whole, so one bad plan leaves the others alone. An op_key belongs to
    one plan (applied: plan_id, op_key), so what is dealt by plan_id is not shuffled."""
    both = ops.withColumn("done", F.lit(False)).unionByName(applied.select("plan_id", "op_key", F.lit(True).alias("done")), allowMissingColumns=True)
    key = Window.partitionBy("plan_id", "op_key")
    first = F.row_number().over(key.orderBy("done", "place", "claim_id")) == 1
    rows = both.withColumns({"first": first, "known": F.bool_or("done").over(key)}).filter("NOT done").drop("done").withColumnRenamed("known", "done")
    rows = rows.join(bad_plans.select("plan_id", F.lit(True).alias("bad")).distinct(), "plan_id", "left")
    outcome = first_that((F.col("bad"), "refused"), (F.col("done"), "skipped"), (~F.col("first"), "repeated"), otherwise="would_apply")
    return rows.withColumn("outcome", outcome).drop("first", "done", "bad")


def rollback(applied: DataFrame) -> DataFrame:
    """plan_id, step, action, target, restore (previous values) and lost (changed properties whose previous value was not
    read) that undo what was written, the last first: edges go before the nodes that they join.

    applied: plan_id, written_at (the order of writing), kind (NODE, RELATIONSHIP, PROPERTIES; others wrote nothing),
    created (the node or edge made), target (what was changed), changed (names of properties), previous (map of the values
    read before; null: none).
    """
    return undone(last_first(applied.filter(F.col("kind").isin(*UNDOES))))


def last_first(written: DataFrame, *order: str) -> DataFrame:
    """What was written (plan_id and others) with step, the last first: by written_at, or by the columns that give the order."""
    return written.withColumn("step", F.row_number().over(Window.partitionBy("plan_id").orderBy(*[F.col(c).desc() for c in order or ["written_at"]])))


def undone(rows: DataFrame) -> DataFrame:
    """The rows of rollback() for rows (plan_id, step, kind, created, target, changed, previous)."""
    action = first_that(*[(F.col("kind") == k, v) for k, v in UNDOES.items()], otherwise=None)
    set_ = F.col("kind") == "PROPERTIES"
    none = F.array().cast("array<string>")
    read = F.coalesce(F.map_keys("previous"), none)
    return rows.select(
        "plan_id", "step", action.alias("action"), F.when(F.col("kind") == "RELATIONSHIP", F.col("created")).otherwise(F.col("target")).alias("target"),
        F.when(set_, F.col("previous")).alias("restore"), F.when(set_, F.array_sort(F.array_except(F.coalesce("changed", none), read))).otherwise(none).alias("lost"),
    )


def endpoints(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """rel_id and ends of every row of relations (rel_id, a, b, scope): both ends must be nodes (node_id, scope) of the
    relation's scope or of the shared one (null). ok, missing (no such node anywhere) or other_scope, the worse of both
    ends. A node may have rows in several scopes; a relation's row is never multiplied by them."""
    known = nodes.groupBy("node_id").agg(F.bool_or(F.col("scope").isNull()).alias("shared"), F.collect_set("scope").alias("scopes"))
    of = lambda end: known.select(F.col("node_id").alias(end), F.struct("shared", "scopes").alias(f"{end}_node"))
    rows = relations.join(of("a"), "a", "left").join(of("b"), "b", "left")
    seen = lambda n: first_that((F.col(n).isNull(), 2), (F.col(f"{n}.shared") | F.array_contains(F.col(f"{n}.scopes"), F.col("scope")), 0), otherwise=1)
    worst = F.greatest(seen("a_node"), seen("b_node"))
    return rows.select("rel_id", first_that((worst == 0, "ok"), (worst == 1, "other_scope"), otherwise="missing").alias("ends"))


def kept_mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by text and place; only the end of the last kept mention is held."""
    text, until = (), -1
    for batch in batches:
        keep = []
        for id_, start, end in zip(*(batch.column(c).to_pylist() for c in ("text_id", "start", "end"))):
            if (id_,) != text:
                text, until = (id_,), -1
            keep.append(start >= until)
            if keep[-1]:
                until = end
        yield batch.filter(pa.array(keep, pa.bool_()))


def deduped_mentions(hits: DataFrame) -> DataFrame:
    """hits (text_id, start, end, confidence, surface) without those that overlap an earlier kept one: by start, then the
    longest, the surest and the surface. A null text_id is a text of its own; a hit without start or end is none. Texts
    of any number of hits stream through a task."""
    hits = hits.select("text_id", "start", "end", "confidence", "surface").filter("start IS NOT NULL AND end IS NOT NULL")
    order = ["text_id", F.col("start"), (F.col("start") - F.col("end")), F.col("confidence").desc(), F.col("surface")]
    return hits.repartition("text_id").sortWithinPartitions(*order).mapInArrow(kept_mentions, hits.schema)


def antecedents(tokens: DataFrame, most: int) -> DataFrame:
    """text_id, place, status and entity of pronouns: tokens (text_id, place, kind, entity), kind mention or pronoun.

    The antecedent is the only entity mentioned at most so many places before; none or several give a diagnosis instead.
    A frame of fixed width runs over a text's places.
    """
    frame = Window.partitionBy("text_id").orderBy("place").rangeBetween(-most, -1)
    said = F.when(F.col("kind") == "mention", F.col("entity"))
    rows = tokens.select("text_id", "place", "kind", F.min(said).over(frame).alias("lo"), F.max(said).over(frame).alias("hi")).filter("kind = 'pronoun'")
    status = first_that((F.col("lo").isNull(), "no_antecedent"), (F.col("lo") != F.col("hi"), "ambiguous"), otherwise="resolved")
    return rows.select("text_id", "place", status.alias("status"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("entity"))


def error_forms(terms: DataFrame) -> DataFrame:
    """form, canonical and confidence: each wrong form of the terms (canonical, confidence, forms) once, folded to lower
    case, with the surest term, then the first by name. Empty forms and a term's own name are none."""
    rows = terms.select("canonical", "confidence", F.explode("forms").alias("f")).withColumn("form", F.lower(F.trim("f")))
    rows = rows.filter("form <> '' AND form <> lower(canonical)")
    best = rows.groupBy("form").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "canonical")).alias("best"))
    return best.select("form", "best.canonical", (-F.col("best.c")).alias("confidence"))


def alias_map(entities: DataFrame, glossary: DataFrame) -> DataFrame:
    """alias and entity: full names of entities (entity, name) first, then words of three letters or more that only one
    entity has, then the glossary's aliases (alias, entity); the first source that knows an alias wins, ties by entity."""
    names = entities.select(F.lower("name").alias("alias"), "entity")
    words = entities.select(F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("alias"), "entity").filter(F.length("alias") >= 3)
    unique = words.groupBy("alias").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).filter("entity = other").select("alias", "entity")
    every = names.withColumn("rank", F.lit(1)).union(unique.withColumn("rank", F.lit(2))).union(glossary.select(F.lower("alias"), "entity").withColumn("rank", F.lit(3)))
    return every.filter("alias <> ''").groupBy("alias").agg(F.min(F.struct("rank", "entity")).alias("m")).select("alias", "m.entity")


def state_of(scope: Column) -> Column:
    """The value after state= in a scope whose parts | separates; UNKNOWN where it is absent or no state."""
    state = F.regexp_extract(scope, r"(?:^|\|)\s*state=([^|]*)", 1)
    return F.coalesce(F.when(F.upper(F.trim(state)).isin("ACTIVE", "ENDED", "FUTURE", "PAST", "UNKNOWN"), F.upper(F.trim(state))), F.lit("UNKNOWN"))


def safe_path(name: Column) -> Column:
    """Whether a name stays below its folder: not empty, absolute, of a drive, with a NUL or a .. part."""
    return F.coalesce((name != "") & ~name.rlike(r"\x00|^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)"), F.lit(False))


def subgroup_rates(rows: DataFrame, flags: list[str], groups: dict[str, Column]) -> DataFrame:
    """part, n and the rate of each flag over all rows and over the rows of each group (0 where there are none); all
    groups are counted in one pass."""
    parts = F.array(F.lit("all"), *[F.when(c, F.lit(g)) for g, c in groups.items()])
    found = rows.select(F.explode(parts).alias("part"), *flags).filter("part IS NOT NULL").groupBy("part").agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    names = rows.sparkSession.createDataFrame([(g,) for g in ["all", *groups]], "part string")
    out = names.join(found, "part", "left")
    return out.select("part", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(ratio(F.col(f), F.col("n"), 4), F.lit(0.0)).alias(f) for f in flags])
