"""Queries on one-to-one matching, islands of spans and merged proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import matching, merging
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def walk(candidates: str, order: str, left: str, right: str, by: str) -> str:
    """The sequential matcher in recursive SQL: a step a candidate of its group, in order, with what is taken so far."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {candidates}),
walk AS (SELECT {by} AS g, rn, TRUE AS kept, [{left}] AS ls, [{right}] AS rs FROM ranked WHERE rn = 1
  UNION ALL SELECT g, n.rn, ok, CASE WHEN ok THEN list_append(ls, n.{left}) ELSE ls END, CASE WHEN ok THEN list_append(rs, n.{right}) ELSE rs END
  FROM (SELECT w.*, r.rn AS next, r.{left}, r.{right}, NOT list_contains(w.ls, r.{left}) AND NOT list_contains(w.rs, r.{right}) AS ok FROM walk w JOIN ranked r ON r.{by} = w.g AND r.rn = w.rn + 1) n(g, rn0, k0, ls, rs, rn, {left}, {right}, ok)),
matched AS (SELECT r.* FROM ranked r JOIN walk w ON w.g = r.{by} AND w.rn = r.rn AND w.kept)"""


# Lines that repeat an order and number are told apart by part and supplier.
ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
SPANS = f"SELECT l_suppkey AS key, {ID} AS id, l_partkey * 37 % 9000 AS start, l_partkey * 37 % 9000 + CAST(l_quantity AS BIGINT) AS stop, l_returnflag FROM lineitem"


def line():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def spans(spark, sf):
    start = F.col("l_partkey") * 37 % 9000
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), line().alias("id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), "l_returnflag")


@query("matched_spans", f"""WITH RECURSIVE s AS ({SPANS}),
c AS (SELECT g.key, g.id AS gold_id, p.id AS pred_id, round((least(g.stop, p.stop) - greatest(g.start, p.start)) / (greatest(g.stop, p.stop) - least(g.start, p.start))::DOUBLE, 6) AS iou FROM s g JOIN s p ON g.key = p.key AND g.start < p.stop AND p.start < g.stop AND g.l_returnflag <> 'N' AND p.l_returnflag = 'N'),
near AS (SELECT * FROM c WHERE iou >= 0.5), {walk('near', '-iou, gold_id, pred_id', 'gold_id', 'pred_id', 'key')} SELECT key, gold_id, pred_id, iou FROM matched""")
def matched_spans(spark, sf):
    """Returned lines (A, R) are gold, the others predicted: every line is on a side."""
    rows = spans(spark, sf)
    return matching.match_spans(rows.filter("l_returnflag <> 'N'"), rows.filter("l_returnflag = 'N'"))


@query("cluster_alignment", f"""WITH RECURSIVE i AS (SELECT 'c' || l_suppkey % 40 AS gold, 'c' || l_partkey * 7 % 41 AS predicted FROM lineitem), p AS (SELECT gold, predicted, count(*) AS n FROM i GROUP BY ALL),
fixed AS (SELECT DISTINCT predicted AS name FROM i WHERE predicted IN ('c1', 'c3', 'c40') AND predicted IN (SELECT gold FROM i)),
free AS (SELECT *, 1 AS one FROM p WHERE predicted NOT IN (SELECT name FROM fixed) AND gold NOT IN (SELECT name FROM fixed)), {walk('free', '-n, predicted, gold', 'predicted', 'gold', 'one')}
SELECT predicted, gold, n FROM matched UNION ALL SELECT name, name, coalesce((SELECT n FROM p WHERE p.gold = name AND p.predicted = name), 0) FROM fixed""")
def cluster_alignment(spark, sf):
    items = table(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey") % 40).alias("gold"), F.concat(F.lit("c"), F.col("l_partkey") * 7 % 41).alias("predicted"))
    return matching.align_clusters(items, spark.createDataFrame([("c1",), ("c3",), ("c40",)], "name string"))


RELATION = f"""SELECT l_orderkey % 50 AS source, {ID} AS id, l_suppkey % 12 AS a, l_partkey % 12 AS b, 'P' || l_linenumber % 3 AS predicate, CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN 'AB' ELSE 'BA' END AS direction, l_returnflag FROM lineitem"""


@query("matched_relations", f"""WITH RECURSIVE r AS ({RELATION}),
c AS (SELECT g.source * 1000 + least(g.a, g.b) * 20 + greatest(g.a, g.b) AS bucket, g.source, g.id AS gold_id, p.id AS pred_id, g.predicate = p.predicate AS predicate_ok, g.direction = p.direction AS direction_ok
  FROM r g JOIN r p ON g.source = p.source AND least(g.a, g.b) = least(p.a, p.b) AND greatest(g.a, g.b) = greatest(p.a, p.b) AND g.l_returnflag = 'A' AND p.l_returnflag <> 'A'),
{walk('c', 'gold_id, NOT predicate_ok, NOT direction_ok, pred_id', 'gold_id', 'pred_id', 'bucket')} SELECT source, gold_id, pred_id, predicate_ok, direction_ok FROM matched""")
def matched_relations(spark, sf):
    direction = F.when(F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz"), "AB").otherwise("BA")
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("source"), line().alias("id"), (F.col("l_suppkey") % 12).alias("a"), (F.col("l_partkey") % 12).alias("b"),
        F.concat(F.lit("P"), F.col("l_linenumber") % 3).alias("predicate"), direction.alias("direction"), "l_returnflag",
    )
    return matching.match_relations(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag <> 'A'"))


@query("span_islands", f"""WITH s AS ({SPANS}), o AS (SELECT *, max(stop) OVER (PARTITION BY key ORDER BY start, stop, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
n AS (SELECT *, sum(CASE WHEN start < reach THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY start, stop, id) AS island FROM o)
SELECT key, min(start) AS start, max(stop) AS stop, count(*) AS n, arg_min(id, (start - stop, id)) AS best FROM n GROUP BY key, island""")
def span_islands(spark, sf):
    return merging.merged_islands(spans(spark, sf).withColumn("confidence", F.lit(1.0)), 500).withColumnRenamed("end", "stop")


MENTION = f"""SELECT {ID} AS id, l_suppkey % 25 AS asset, l_partkey % 40 AS start, l_linenumber, l_returnflag, l_discount, l_orderkey FROM lineitem"""


@query("merged_mentions", f"""WITH m AS (SELECT 'm' || id AS mention_id, asset, start, l_linenumber % 2 AS n, l_returnflag AS family, round(l_discount, 2) AS confidence, 'f' || l_orderkey % 5 AS evidence, 'T' || l_linenumber % 3 AS type, round(l_discount / 2, 4) AS tc FROM ({MENTION})),
g AS (SELECT asset, start, n, min(mention_id) AS least, max(mention_id) AS most, max(confidence) AS confidence, count(*) AS proposals, count(DISTINCT family) AS families, list_sort(list_distinct(list(evidence))) AS evidence FROM m GROUP BY ALL),
t AS (SELECT asset, start, n, type, max(tc) AS tc FROM m GROUP BY ALL), u AS (SELECT asset, start, n, string_agg(type || ':' || printf('%.4f', tc), ',' ORDER BY tc DESC, type) AS types FROM t GROUP BY ALL)
SELECT asset, start, start + n + 3 AS stop, least = most AS alone, round(confidence, 4) AS confidence, proposals, families, array_to_string(evidence, ',') AS evidence, types FROM g JOIN u USING (asset, start, n)""")
def merged_mentions(spark, sf):
    rows = table(spark, sf, "lineitem")
    n = F.col("l_linenumber") % 2
    mentions = rows.select(
        F.lit("w").alias("workspace"), (F.col("l_suppkey") % 25).alias("asset"), F.lit("e").alias("episode"), F.lit("episode").alias("basis"), (F.col("l_partkey") % 40).alias("start"), (F.col("l_partkey") % 40 + n + 3).alias("end"),
        F.concat(F.lit("s"), n).alias("surface"), F.concat(F.lit("m"), line()).alias("mention_id"), F.round("l_discount", 2).alias("confidence"),
        F.array(F.struct(F.concat(F.lit("T"), F.col("l_linenumber") % 3).alias("type"), F.round(F.col("l_discount") / 2, 4).alias("confidence"))).alias("types"),
        F.array(F.concat(F.lit("f"), F.col("l_orderkey") % 5)).alias("evidence"), F.array(F.concat(F.lit("m"), F.col("l_orderkey") * 10 + 1)).alias("coreferents"), F.col("l_returnflag").alias("family"),
    )
    kept, _ = merging.reconcile_mentions(mentions)
    shown = F.array_join(F.transform("types", lambda t: F.concat(t["type"], F.lit(":"), F.format_string("%.4f", t["confidence"]))), ",")
    return kept.select("asset", "start", F.col("end").alias("stop"), (~F.col("mention_id").startswith("mention:")).alias("alone"), "confidence", "proposals", "families", F.array_join("evidence", ",").alias("evidence"), shown.alias("types"))
