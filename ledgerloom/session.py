"""Session settings used by the tests and the bench (a cluster brings its own session), and the folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", app: str = "ledgerloom") -> SparkSession:
    """A local session with adaptive execution and UTC times."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster intermediate tables need a folder that all machines share")
    return (found or "/tmp/checkpoints").rstrip("/")


#: Rows of a key's partition, about.
PARTITION_ROWS = 300_000


def partitions(spark: SparkSession, rows: int) -> int:
    """As many partitions as rows ask for, so that a task's memory does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))


def dealt(frame: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame dealt out by keys, so that what is grouped, sorted or windowed by them and more columns is not shuffled again.
    There are as many partitions as rows ask for."""
    return frame.repartition(partitions(frame.sparkSession, rows), *keys)


def spread(frame: DataFrame) -> DataFrame:
    """The frame's rows dealt out evenly, for rows that take long each: a table in one file of a few MB is read by one task."""
    return frame.repartition(partitions(frame.sparkSession, frame.count()))


def staged(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes the frame as a table in the shared folder and reads it back: the lineage ends there and a lost executor loses nothing."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
