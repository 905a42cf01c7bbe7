"""Islands of overlapping spans, and proposals of several extractors merged by what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.scores import first_that


def running_max(rows: DataFrame, key: str, bin_: str, order: list[Column], value: str, name: str, own: bool) -> DataFrame:
    """rows with the greatest value of those before in the key's order (own: and of the row itself and its equals).

    Rows are ordered within bins; what comes from earlier bins is one row a bin, so a key with any number of rows is
    spread over as many tasks as it has bins.
    """
    inside = Window.partitionBy(key, bin_).orderBy(*order)  # by default up to the row and its equals
    inside = inside if own else inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(key, bin_).agg(F.max(value).alias("__most")).withColumn("__before", F.max("__most").over(earlier)).drop("__most")
    joined = rows.withColumn("__inside", F.max(value).over(inside)).join(bins, [key, bin_])
    return joined.withColumn(name, F.greatest("__inside", "__before")).drop("__inside", "__before")


def islands(spans: DataFrame, width: int, touching: bool = False) -> DataFrame:
    """spans (key, start, end and others) with island: the start of the run of overlapping spans that each lies in.

    A span opens an island if it starts at or behind the greatest end before it (with touching: only behind it). width is
    that of the bins, a few thousand rows' worth. Spans without a key, a start or an end, or that end before they start,
    are dropped; repeated and nested spans lie in the same island; an empty span lies in that which surrounds its place.
    """
    rows = spans.filter("key IS NOT NULL AND end >= start").withColumn("__bin", F.floor(F.col("start") / width))
    order = [F.col("start"), F.col("end")]
    rows = running_max(rows, "key", "__bin", order, "end", "__reach", own=False)
    apart = F.col("start") > F.col("__reach") if touching else F.col("start") >= F.col("__reach")
    rows = rows.withColumn("__open", F.when(F.coalesce(apart, F.lit(True)), F.col("start")))
    return running_max(rows, "key", "__bin", order, "__open", "island", own=True).drop("__bin", "__reach", "__open")


def merged_islands(spans: DataFrame, width: int, touching: bool = False) -> DataFrame:
    """key, start, end, n and best (the longest span's id, then the surest, then the least id) of each island of spans (key,
    id, start, end, confidence)."""
    rank = F.struct((F.col("start") - F.col("end")).alias("a"), (-F.col("confidence")).alias("b"), "id")
    return islands(spans, width, touching).groupBy("key", F.col("island").alias("start")).agg(F.max("end").alias("end"), F.count("*").alias("n"), F.min(rank)["id"].alias("best"))


# ---- proposals of several extractors

MENTION_KEY = ["workspace", "asset", "episode", "basis", "start", "end", "surface"]
CLAIM_KEY = ["workspace", "asset", "episode", "subjects", "objects", "evidence", "phrase", "negated", "negation", "status", "abstained", "review"]
COREFERENT_KEY = ["workspace", "asset", "episode", "subjects", "objects", "negated", "abstained"]
#: Families whose proposals come first as the base of a merged one: what is most external must stay visible.
AUTHORITY = ("external", "ollama")


def hashed(prefix: str, columns: list[str]) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.left(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), F.lit(16)))


def distinct_sorted(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))))


def united(rows: DataFrame, key: list[str], of: str, out: str) -> DataFrame:
    """key and the sorted distinct elements of an array column; elements are made distinct before they are collected."""
    each = rows.select(*key, F.explode(of).alias("x")).distinct()
    return each.groupBy(*key).agg(F.array_sort(F.collect_set("x")).alias(out))


def best_candidates(rows: DataFrame, key: list[str], of: str, name: str) -> DataFrame:
    """key and the candidates (name, confidence) with each name's best confidence, the surest first, then by name."""
    each = rows.select(*key, F.inline(of)).groupBy(*key, name).agg(F.max("confidence").alias("confidence"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), F.col(name).alias("n"))))
    return each.groupBy(*key).agg(F.transform(ordered, lambda x: F.struct(x["n"].alias(name), (-x["c"]).alias("confidence"))).alias(of))


def reconcile_mentions(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, ids): proposals of the same span and surface become one; ids maps every mention_id to that which stays.

    mentions: MENTION_KEY, mention_id, confidence, types (array of type and confidence), evidence, coreferents (arrays of
    ids), family. A merged mention has a hashed id, the best confidence, each type's best, all evidence and coreferents
    (as they are called now, without itself), and counts its proposals and families. A mention alone keeps its id, and
    null parts of the key are equal to each other. Elements are made distinct before they are collected, so proposals
    repeated any number of times add nothing to a row.
    """
    rows = mentions.withColumn("key", hashed("mention", MENTION_KEY))
    groups = rows.groupBy("key").agg(F.min("mention_id").alias("least"), F.max("mention_id").alias("most"), F.max("confidence").alias("confidence"), F.count("*").alias("proposals"), F.count_distinct("family").alias("families"), *[F.first(c).alias(c) for c in MENTION_KEY])
    groups = groups.withColumn("new_id", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.col("key")))
    ids = rows.select("mention_id", "key").distinct().join(groups.select("key", "new_id"), "key").select("mention_id", "new_id")
    coreferents = rows.select("key", F.explode("coreferents").alias("mention_id")).distinct().join(ids, "mention_id", "left")
    coreferents = coreferents.select("key", F.coalesce("new_id", "mention_id").alias("x")).join(groups.select("key", "new_id"), "key").filter("x <> new_id")
    coreferents = coreferents.groupBy("key").agg(F.array_sort(F.collect_set("x")).alias("coreferents"))
    none = F.array().cast("array<string>")
    out = groups.join(united(rows, ["key"], "evidence", "evidence"), "key", "left").join(coreferents, "key", "left").join(best_candidates(rows, ["key"], "types", "type"), "key", "left")
    return out.select(F.col("new_id").alias("mention_id"), *MENTION_KEY, "confidence", "types", F.coalesce("evidence", none).alias("evidence"), F.coalesce("coreferents", none).alias("coreferents"), "proposals", "families"), ids


def renamed(claims: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """claims with the mentions of a column called as they are now, each once, sorted."""
    each = claims.select("claim_id", F.explode(column).alias("mention_id")).distinct().join(ids, "mention_id", "left")
    found = each.groupBy("claim_id").agg(F.array_sort(F.collect_set(F.coalesce("new_id", "mention_id"))).alias("__new"))
    return claims.join(found, "claim_id", "left").withColumn(column, F.coalesce("__new", F.array().cast("array<string>"))).drop("__new")


def merge_claims(claims: DataFrame, key: list[str], least_families: int = 1) -> DataFrame:
    """claims of the same key as one, where they are of so many families at least and, for more than one, all need a
    review; the others stay as they are.

    claims: CLAIM_KEY, claim_id, predicates (array of predicate and confidence), confidence, family, proposals, families. The
    base of a merged claim is the one of the most external family, then the least id; its predicates are each one's best.
    """
    rows = claims.withColumn("key", hashed("claim", key))
    rank = F.struct(first_that(*[(F.col("family") == f, k) for k, f in enumerate(AUTHORITY)], otherwise=len(AUTHORITY)).alias("a"), "claim_id")
    base = [c for c in CLAIM_KEY if c not in key]
    groups = rows.groupBy("key").agg(
        F.min("claim_id").alias("least"), F.max("claim_id").alias("most"), F.count_distinct("family").alias("n"), F.bool_and("review").alias("asked"),
        F.max("confidence").alias("top"), F.sum("proposals").alias("all_proposals"), F.min_by(F.struct("family", *base), rank).alias("base"),
    )
    joins = (F.col("least") != F.col("most")) & (F.col("n") >= least_families) & (F.lit(least_families == 1) | F.col("asked"))
    flagged = rows.join(groups.withColumn("joins", F.coalesce(joins, F.lit(False))), "key")
    alone = flagged.filter("NOT joins").select(*claims.columns)
    merged = groups.filter(joins).join(best_candidates(rows, ["key"], "predicates", "predicate"), "key", "left").join(rows.groupBy("key").agg(*[F.first(c).alias(c) for c in key]), "key")
    none = F.array().cast(dict(claims.dtypes)["predicates"])
    merged = merged.withColumns({c: F.col(f"base.{c}") for c in ["family", *base]}).withColumns({
        "claim_id": F.col("key"), "confidence": F.when(F.col("abstained"), 0.0).otherwise(F.col("top")), "proposals": F.col("all_proposals"), "families": F.col("n"),
        "predicates": F.when(F.col("abstained"), none).otherwise(F.coalesce("predicates", none)),
    })
    return alone.unionByName(merged.select(*claims.columns))


def reconcile(mentions: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions and claims of several extractors, reconciled: mentions of one span become one, claims name what stays, claims
    that say the same become one, and then claims of different families on the same mentions that all need a review.

    claims: those of merge_claims without proposals and families. Subjects, objects and evidence are sets; phrases are
    compared in lower case, without white space at their ends.
    """
    kept, ids = reconcile_mentions(mentions)
    rows = claims.withColumns({
        "phrase": F.lower(F.trim(F.coalesce("phrase", F.lit("")))), "evidence": distinct_sorted("evidence"), "negation": F.when(F.col("negated"), F.coalesce("negation", F.lit(""))).otherwise(""),
        "proposals": F.lit(1).cast("long"), "families": F.lit(1).cast("long"),
    })
    rows = renamed(renamed(rows, ids, "subjects"), ids, "objects")
    return kept, merge_claims(merge_claims(rows, CLAIM_KEY), COREFERENT_KEY, 2)
