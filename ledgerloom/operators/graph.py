"""The property graph: nodes and edges as tables, lookups, pages, facets, audits, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.scores import first_that
from ledgerloom.sources.tables import table

LEVELS = ["public", "player", "reference", "narrator", "secret"]


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """node_id, kind, name, workspace, confidence and visibility of customers, suppliers, nations and regions."""
    def of(name, prefix, key, label, workspace):
        k = F.col(key).cast("long")
        return table(spark, sf, name).select(
            F.concat_ws(":", F.lit(prefix), k.cast("string")).alias("node_id"), F.lit(prefix).alias("kind"), F.col(label).alias("name"),
            F.concat(F.lit("w"), (F.col(workspace) % 5).cast("string")).alias("workspace"),
            F.when(k % 11 != 0, F.round(k * 37 % 100 / 100, 6)).alias("confidence"),
            first_that(*[(k % 6 == i, v) for i, v in enumerate(LEVELS)], otherwise=None).alias("visibility"),
        )

    return (
        of("customer", "customer", "c_custkey", "c_name", "c_nationkey").union(of("supplier", "supplier", "s_suppkey", "s_name", "s_nationkey"))
        .union(of("nation", "nation", "n_nationkey", "n_name", "n_regionkey")).union(of("region", "region", "r_regionkey", "r_name", "r_regionkey"))
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, rel and weight: where customers and suppliers are, what nations belong to, how often a customer buys in a priority."""
    ident = lambda prefix, key: F.concat_ws(":", F.lit(prefix), F.col(key).cast("long").cast("string"))
    link = lambda name, a, ka, b, kb, rel: table(spark, sf, name).select(ident(a, ka).alias("src"), ident(b, kb).alias("dst"), F.lit(rel).alias("rel"), F.lit(1).cast("long").alias("weight"))
    return (
        link("customer", "customer", "c_custkey", "nation", "c_nationkey", "LOCATED_IN")
        .union(link("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "BASED_IN"))
        .union(link("nation", "nation", "n_nationkey", "region", "n_regionkey", "PART_OF"))
    )


def search(rows: DataFrame, needle: str, workspace: str | None = None) -> DataFrame:
    """Nodes whose name contains the needle whatever its case; a blank needle finds none."""
    found = rows.filter(F.contains(F.lower("name"), F.lit(needle.strip().lower())) & F.lit(bool(needle.strip())))
    return found.filter(F.col("workspace") == workspace) if workspace else found


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of the ordered rows with its 1-based place and the total, which is counted before paging."""
    first = (number - 1) * size
    some = rows.orderBy(*order).limit(first + size)  # a top-k, so the whole table is not sorted
    place = F.row_number().over(Window.orderBy(*order)).cast("long")
    return some.withColumn("place", place).filter(F.col("place") > first).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def within(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes: one join a side, whatever the degrees."""
    ids = node_rows.select("node_id")
    return edge_rows.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def incident(edge_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node_id, other, rel and side of every edge at the wanted nodes (node_id)."""
    out = edge_rows.join(wanted.withColumnRenamed("node_id", "src"), "src").select(F.col("src").alias("node_id"), F.col("dst").alias("other"), "rel", F.lit("out").alias("side"))
    into = edge_rows.join(wanted.withColumnRenamed("node_id", "dst"), "dst").select(F.col("dst").alias("node_id"), F.col("src").alias("other"), "rel", F.lit("in").alias("side"))
    return out.union(into)


def quality_counts(rows: DataFrame) -> DataFrame:
    """All counts of the quality panel in one pass."""
    c = F.col("confidence")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"),
        F.count_if(c.isNull()).alias("unknown"), F.count_if(F.col("visibility").isNull()).alias("no_visibility"),
    )


def duplicate_names(rows: DataFrame) -> DataFrame:
    """Folded names that several nodes of a workspace have, with the nodes in order."""
    return rows.groupBy("workspace", T.fold(F.col("name")).alias("folded")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("nodes")).filter("n > 1")


def components(links: DataFrame, checkpoint_dir: str) -> DataFrame:
    """node and root (the least node it is connected with) of links (a, b): star contraction, each round written out."""
    spark = links.sparkSession

    def staged(frame):
        path = f"{checkpoint_dir}/components-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    tree = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = tree.union(tree.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        tree = staged(large.join(near, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near).distinct())
        now = tuple(tree.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return tree.select(F.col("u").alias("node"), F.col("v").alias("root")).union(tree.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
