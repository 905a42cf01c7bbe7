"""Markdown texts as blocks: headings, lists, quotes, tables, fenced code and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.scores import first_that


def kind(line: Column, fenced: Column) -> Column:
    """What a line is; within a fence all is code."""
    return first_that(
        (fenced, "code"), (F.trim(F.translate(line, "\t", " ")) == "", "blank"), (line.rlike("^#{1,6} "), "heading"), (line.rlike("^ *([-*+]|[0-9]+[.)]) "), "list"),
        (line.rlike("^ *>"), "quote"), (line.rlike("^ *[|]"), "table"), otherwise="paragraph",
    )


def blocks(documents: DataFrame) -> DataFrame:
    """doc_id, first_line, kind, lines, section (the last heading before or at it) and text of the blocks of documents.

    Lines of one kind in a row are one block; each heading is its own; blank lines part blocks. A fence opens with ``` and
    closes with the next. The window runs over one text's lines. Null texts have no blocks.
    """
    rows = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    by = Window.partitionBy("doc_id").orderBy("line_no")
    fence = F.col("line").rlike("^ *```")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(by)).withColumn("kind", kind(F.col("line"), fence | (F.col("fences") % 2 == 1)))
    starts = (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(by))
    rows = rows.withColumn("block", F.sum(starts.cast("int")).over(by)).withColumn("section", F.last(F.when(F.col("kind") == "heading", F.regexp_replace("line", "^#+ +", "")), ignorenulls=True).over(by))
    out = rows.filter("kind <> 'blank'").groupBy("doc_id", "block", "kind").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("lines"), F.first("section").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    return out.drop("block")
