"""Entity resolution: candidates by exact name, alias and likeness, scores, margins and decisions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.scores import first_that

LINK, REVIEW, MARGIN, LEAST_LIKE = 0.90, 0.60, 0.10, 0.50
EXACT, ALIAS, LIKE = 1.0, 0.95, 0.88


def candidates(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mention_id, entity_id, tier and score of the best candidate tier for each pair.

    mentions: mention_id, surface; entities: entity_id, name, aliases. Likeness joins on shared tokens of the folded
    names, so no pair without a common token is looked at.
    """
    m = mentions.withColumn("folded", T.fold(F.col("surface")))
    e = entities.withColumn("folded_name", T.fold(F.col("name")))
    exact = m.join(e, m["folded"] == e["folded_name"]).select("mention_id", "entity_id", F.lit("exact").alias("tier"), F.lit(EXACT).alias("score"))
    alias = e.select("entity_id", F.explode("aliases").alias("alias")).select("entity_id", T.fold(F.col("alias")).alias("folded"))
    aliased = m.join(alias, "folded").select("mention_id", "entity_id", F.lit("alias").alias("tier"), F.lit(ALIAS).alias("score"))
    # Folded names, tokens and trigrams are made once a row, before the pairs.
    ready = lambda rows, id_, name, end: rows.select(F.col(id_), T.fold(F.col(name)).alias(f"x{end}"), T.token_set(F.col(name)).alias(f"t{end}"), T.ngrams(F.col(name), 3).alias(f"g{end}"))
    left, right = ready(m, "mention_id", "surface", "1"), ready(e, "entity_id", "name", "2")
    met = left.select("mention_id", F.explode("t1").alias("token")).join(right.select("entity_id", F.explode("t2").alias("token")), "token").select("mention_id", "entity_id").distinct()
    pairs = met.join(left, "mention_id").join(right, "entity_id")
    # The edit distance is at least the difference in length, so most pairs go before it is computed.
    x, y, tokens = F.col("x1"), F.col("x2"), T.jaccard(F.col("t1"), F.col("t2"))
    longest = F.greatest(F.length(x), F.length(y))
    pairs = pairs.filter((tokens >= LEAST_LIKE) | (1 - 0.75 * F.abs(F.length(x) - F.length(y)) / longest >= LEAST_LIKE))
    mixed = 0.75 * T.edit_ratio(x, y) + 0.25 * T.jaccard(F.col("g1"), F.col("g2"))
    like = pairs.withColumn("like", F.when(x == y, 1.0).otherwise(F.round(F.greatest(mixed, tokens), 6))).filter(F.col("like") >= LEAST_LIKE)
    like = like.select("mention_id", "entity_id", F.lit("like").alias("tier"), F.round(LIKE * F.col("like"), 6).alias("score"))
    best = Window.partitionBy("mention_id", "entity_id").orderBy(F.desc("score"), "tier")
    return exact.union(aliased).union(like).withColumn("rk", F.row_number().over(best)).filter("rk = 1").drop("rk")


def decide(scored: DataFrame) -> DataFrame:
    """mention_id, entity_id, score, margin and action of the first candidate: linked, to review, or new."""
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    ranked = scored.withColumn("rk", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).filter("rk = 1")
    margin = F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 6)
    action = first_that(
        (F.col("next").isNotNull() & (margin < MARGIN), "REVIEW"), (F.col("score") >= LINK, "LINK"), (F.col("score") >= REVIEW, "REVIEW"), otherwise="CREATE_NEW"
    )
    return ranked.select("mention_id", "entity_id", "score", margin.alias("margin"), action.alias("action"))


def resolved(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """decide(candidates(mentions, entities)) for tables in which names come often: each distinct surface is compared with
    each distinct name once, however many mentions and entities have them.

    Entities with the same name and aliases score the same, so only the two with the least ids can be first and next.
    Mentions without a candidate have no row.
    """
    names = entities.groupBy("name", "aliases").agg(F.min("entity_id").alias("entity_id"))
    others = entities.join(names.withColumnRenamed("entity_id", "least"), entities["name"].eqNullSafe(names["name"]) & entities["aliases"].eqNullSafe(names["aliases"]))
    seconds = others.filter("entity_id > least").groupBy("least").agg(F.min("entity_id").alias("second"))
    surfaces = mentions.select(F.col("surface").alias("mention_id"), "surface").distinct()
    scored = candidates(surfaces, names).join(seconds, F.col("entity_id") == F.col("least"), "left")
    both = F.array_compact(F.array("entity_id", "second"))
    scored = scored.select("mention_id", F.explode(both).alias("entity_id"), "score").groupBy("mention_id", "entity_id").agg(F.max("score").alias("score"))
    decided = decide(scored)
    return mentions.join(decided.withColumnRenamed("mention_id", "surface"), "surface").select("mention_id", "entity_id", "score", "margin", "action")


#: Queries and vectors that a task compares with one another, on average, and queries whose scores it holds at once.
BLOCK, AT_ONCE = 4096, 256
#: More than what the order of a sum, or rounding to six places, changes in a cosine.
SLACK = 2e-6


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score and rank of each query's k nearest vectors by cosine, all compared exactly. The queries are a
    stated set.

    Both sides are dealt to blocks, and each pair of blocks is a group of its own, so memory is bounded, however many rows there are;
    a group gives k rows a query, and more only for scores that rounding may make equal. Vectors of another length, or with
    a null, have a null score and come last.
    """
    parts = lambda rows: max(1, -(-rows.count() // BLOCK))
    # Columns of their own on each side: a cogroup drops what it takes for the same column twice.
    q, v = (rows.filter("vec_id IS NOT NULL").select(F.col("vec_id").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) for rows in (queries, vectors))
    of_q, of_v = parts(q), parts(v)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("vec_id", "embedding", own(of_q).alias("q_block"), every(of_v).alias("v_block"))
    v = v.select("vec_id", "embedding", own(of_v).alias("v_block"), every(of_q).alias("q_block"))
    of = vectors.schema["vec_id"].dataType.simpleString()
    blocks = ["q_block", "v_block"]
    scored = q.groupBy(*blocks).cogroup(v.groupBy(*blocks)).applyInArrow(lambda a, b: nearest_of_block(a, b, k), f"query_id {of}, vec_id {of}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def by_length(rows: pa.Table) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Ids and matrix of the vectors without nulls, by length, and the ids of the others; each by rising id."""
    rows = rows.select(["vec_id", "embedding"]).sort_by("vec_id").combine_chunks()
    ids, lists = rows["vec_id"].to_numpy(), rows["embedding"].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).copy()
    if lists.flatten().null_count:
        lengths[pc.unique(pc.list_parent_indices(lists).filter(lists.flatten().is_null())).to_numpy()] = -1
    found = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths) if n >= 0}
    return {n: (ids[at], lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)) for n, at in found.items()}, ids[lengths < 0]


def nearest_of_block(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """query_id, vec_id and score (unrounded) of the pairs that can be among a query's k nearest."""
    (asked, odd), (held, odd_held) = by_length(queries), by_length(vectors)
    every = np.sort(vectors["vec_id"].to_numpy())
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []

    def unscored(query_ids: np.ndarray, ids: np.ndarray) -> None:
        for query_id in query_ids:
            first = ids[ids != query_id][:k]
            out.append((np.full(len(first), query_id), first, None))

    unscored(odd, every)
    for n, (query_ids, q) in asked.items():
        others = np.sort(np.concatenate([odd_held, *(ids for m, (ids, _) in held.items() if m != n)]))
        if len(others):
            unscored(query_ids, others)
        if n in held:
            for lo in range(0, len(q), AT_ONCE):
                out.append(best_pairs(query_ids[lo : lo + AT_ONCE], q[lo : lo + AT_ONCE], *held[n], k))
    kind = queries.schema.field("vec_id").type
    tables = [pa.table({"query_id": pa.array(a, kind), "vec_id": pa.array(b, kind), "score": pa.nulls(len(a), pa.float64()) if s is None else pa.array(s, pa.float64())}) for a, b, s in out]
    return pa.concat_tables(tables) if tables else pa.table({"query_id": pa.array([], kind), "vec_id": pa.array([], kind), "score": pa.array([], pa.float64())})


def best_pairs(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the vectors within SLACK of its k-th best; of those of an equal score the first k by id."""
    def summed(a, b):  # in the order of the components, so copies score the same
        total = np.zeros(len(a))
        for d in range(a.shape[1]):
            total += a[:, d] * b[:, d]
        return total

    with np.errstate(all="ignore"):
        qn, vn = np.sqrt(summed(q, q)), np.sqrt(summed(v, v))
        near = (q / np.where(qn == 0, 1, qn)[:, None]) @ (v / np.where(vn == 0, 1, vn)[:, None]).T
        near[np.isnan(near)] = np.inf  # comes first, as in an ORDER BY
        near[query_ids[:, None] == ids[None, :]] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -np.inf)
        i, j = np.nonzero((near >= (least - SLACK)[:, None]) & (near > -np.inf))
        score = summed(q[i], v[j])
        norm = (qn[i] == 0) | (vn[j] == 0)
        score = np.where(norm, 0.0, score / np.where(norm, 1, qn[i]) / np.where(norm, 1, vn[j]))
    value = np.where(np.isnan(score), np.inf, score)
    order = np.lexsort((ids[j], -value, i))
    i, j, score, value = i[order], j[order], score[order], value[order]
    new = np.r_[True, (i[1:] != i[:-1]) | (value[1:] != value[:-1])] if len(i) else np.zeros(0, bool)
    nth = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0)) if len(i) else np.zeros(0, int)
    kept = nth < k
    return query_ids[i[kept]], ids[j[kept]], score[kept]


def group_type(mentions: DataFrame, group: str, kind: str, confidence: str) -> DataFrame:
    """group, kind and confidence: the kind with the largest sum of confidences, the first by alphabet among equals, and
    the group's weakest confidence."""
    sums = mentions.groupBy(group, kind).agg(F.sum(confidence).alias("total"), F.min(confidence).alias("weakest"))
    return sums.groupBy(group).agg(
        F.min_by(kind, F.struct(-F.round("total", 6), F.col(kind))).alias("kind"), F.round(F.max("total"), 4).alias("total"), F.round(F.min("weakest"), 6).alias("confidence")
    )


def name_variants(rows: DataFrame, key: str, name: str) -> Column:
    """A name with its words turned round: how people write surnames first."""
    return F.concat_ws(" ", F.reverse(F.split(name, " ")))
