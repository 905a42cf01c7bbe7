"""Joins on intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def overlaps(a: DataFrame, b: DataFrame, key: str, longest: int) -> DataFrame:
    """Pairs (aliases a and b) of an equal key whose half-open intervals [start, end) overlap.

    No interval may be longer than `longest`. Time is cut into cells of that length; an interval lies in at most two, and
    a pair is taken in the cell in which the later of the two starts, so it comes once.
    """
    def cells(frame: DataFrame) -> DataFrame:
        first, last = F.floor(F.col("start") / longest), F.floor((F.col("end") - 1) / longest)
        return frame.withColumn("cell", F.explode(F.sequence(first, last)))

    x, y = cells(a).alias("a"), cells(b).alias("b")
    met = x.join(y, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.cell") == F.col("b.cell")))
    start = F.greatest(F.col("a.start"), F.col("b.start"))
    return met.filter((F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("a.cell") == F.floor(start / longest)))
