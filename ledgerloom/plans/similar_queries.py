"""Queries on similar sets of words and on fuzzy search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import similar
from ledgerloom.plans.text_queries import toks
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


PAIRS = """p AS (SELECT x.id AS left_id, y.id AS right_id, len(list_intersect(x.e, y.e)) AS c, len(x.e) AS n, len(y.e) AS m FROM s x JOIN s y ON x.id < y.id AND list_has_any(x.e, y.e))"""


@query("similar_first_lines", f"""WITH d AS (SELECT doc_id, list_sort(list_distinct({toks("string_split(text, chr(10))[1]")})) AS e FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, e, min(doc_id) OVER (PARTITION BY e) AS id FROM d WHERE len(e) > 0), s AS (SELECT id, e FROM k WHERE id = doc_id),
{PAIRS} SELECT left_id, right_id, round(2 * c / (n + m)::DOUBLE, 6) AS score FROM p WHERE 2 * c / (n + m)::DOUBLE >= 0.7 UNION ALL SELECT id, doc_id, 1.0::DOUBLE FROM k WHERE id <> doc_id""")
def similar_first_lines(spark, sf):
    """Pairs of first lines of different words, each by the first document that has it, and the others with that document."""
    lines = table(spark, sf, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), T.tokens(F.substring_index("text", "\n", 1)).alias("elements"))
    return similar.near_classes(lines, 0.7, "dice")


@query("fuzzy_terms")
def fuzzy_terms(spark, sf):
    """Suppliers' and customers' names, some misspelt, among the parts and customers: SQL has no such likeness of strings, so
    the operator is tested against brute force."""
    parts = table(spark, sf, "part")
    terms = parts.select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("term"), (F.col("p_retailprice") / 1000).alias("priority"), F.array(F.concat("p_brand", F.lit(" "), "p_type")).alias("aliases"), F.array(F.reverse("p_name")).alias("error_forms"))
    asked = parts.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.substring("p_name", F.lit(2), F.length("p_name")), F.lit("x"))).alias("query"))
    return similar.fuzzy_search(asked, terms, 3)


@query("name_groups")
def name_groups(spark, sf):
    """Customers and suppliers whose names may be of one thing, with the groups' scores: tested against brute force."""
    part = table(spark, sf, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_brand").alias("document"), F.array(F.col("p_size"), F.col("p_size") + 1).alias("pages"))
    groups = similar.duplicate_groups(nodes, {"green": "verde"}, 0.9)
    return groups.join(similar.group_scores(groups, nodes), "root")
