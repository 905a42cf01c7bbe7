"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.session import shared_dir, staged  # noqa: F401  (the operators take staged() from here)

#: White space of the result contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows whose texts a Python task holds as strings at a time.
SLICE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def one_spaced(text: Column) -> Column:
    """The text with each run of white space as one space."""
    return F.regexp_replace(text, SPACE, " ")


def bucketed(frame: DataFrame, name: str, n: int, column: str) -> DataFrame:
    """Like staged(), as a table of n buckets by the column: what is joined or grouped by it later does not shuffle it again.

    The catalog's entry goes once the table is read from; its files lie in the shared folder.
    """
    spark = frame.sparkSession
    table_name = f"ledgerloom_{name}_{uuid.uuid4().hex}"
    frame.write.bucketBy(n, column).options(path=f"{shared_dir(spark)}/ledgerloom/{table_name}", compression="zstd").saveAsTable(table_name)
    found = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")
    return found


#: Keys with the most rows that are joined by a broadcast.
HEAVY = 1000


def join_skewed(rows: DataFrame, values: DataFrame, key: str, weight: str) -> DataFrame:
    """rows joined with values (a row a key, with the number of rows that have it as its weight).

    The HEAVY keys of the greatest weight are broadcast, so no task gathers the rows of a hot key; the others are shuffled
    and have at most a thousandth of the rows each. Both are read twice. A null key joins nothing.
    """
    heavy = staged(values.orderBy(F.desc(weight), key).limit(HEAVY), "heavy")
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return hot.unionByName(rest.join(values, key))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, SLICE) for k in range(0, batch.num_rows, SLICE))


def map_slices(rows: DataFrame, task: Callable, schema: str) -> DataFrame:
    """mapInPandas in frames of SLICE rows at most: a worker's memory follows neither Arrow's batches nor their texts."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        frames = (part.to_pandas() for batch in batches for part in slices(batch))
        for frame in task(frames):
            yield pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)

    return rows.mapInArrow(run, schema)
