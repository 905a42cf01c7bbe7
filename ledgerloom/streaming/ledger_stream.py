"""Structured Streaming versions: windowed counts of late events, idempotent ledger append, leases that time out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream of files; event time as a timestamp, which watermarks need."""
    ntz = EVENTS.replace("ts timestamp", "ts timestamp_ntz")
    return spark.readStream.schema(ntz).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by window of event time and type; what comes later than `late` is dropped, which bounds the state."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def once(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote. Complete results replace each other; appended
    ones go to a folder a batch, so that a batch that is tried again leaves one copy."""
    spark, out = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def first_of_each(events: DataFrame, key: list[str], late: str) -> DataFrame:
    """The stream without events whose key came before within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


LEASE = "job bigint, state string, attempts int, at_ms bigint"


def leases(heartbeats: DataFrame, most_attempts: int, timeout_ms: int) -> DataFrame:
    """job, state, attempts and at_ms as workers' heartbeats (job, ts) come and stop: running at each beat; once event time
    has passed the timeout without one, pending again, or failed after so many attempts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempts = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            attempts += 1
            at = state.getCurrentWatermarkMs()
            state.update((attempts,))
            yield pd.DataFrame({"job": [key[0]], "state": ["failed" if attempts >= most_attempts else "pending"], "attempts": [attempts], "at_ms": [at]})
            return
        last = max(int(b["ts"].max().timestamp() * 1000) for b in batches)
        state.update((attempts,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1) + timeout_ms)
        yield pd.DataFrame({"job": [key[0]], "state": ["running"], "attempts": [attempts], "at_ms": [last]})

    return heartbeats.withWatermark("ts", "1 minute").groupBy("job").applyInPandasWithState(step, LEASE, "attempts int", "append", "EventTimeTimeout")
