"""A log of executed plans that only grows: batches of operations are taken whole plan by whole plan or not at all.

Each batch is judged against what earlier batches wrote, and writes one folder of its own. A batch that comes again, after
a failure or twice, is judged against the same earlier batches and replaces its own folder, so nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.scores import first_that
from ledgerloom.operators.merging import islands, running_max
from ledgerloom.session import PARTITION_ROWS, dealt, staged

ENTRY = "workspace string, plan_id string, seq long, op_key string, op string, assertion_id string, other_id string, subject string, object string, at long"
LOG = ENTRY + ", outcome string, reason string, batch long"
#: Sequence numbers in a bin of the islands of plans.
WIDTH = 10_000
#: Applied operations that are sent to every task; more are joined by key.
FEW = 200_000


def read_log(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The log, or what batches before a number wrote."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    rows = spark.read.schema(LOG).parquet(path) if there else spark.createDataFrame([], LOG)
    return rows if before is None else rows.filter(F.col("batch") < before)


def judged(entries: DataFrame, log: DataFrame) -> DataFrame:
    """entries (ENTRY) with outcome and reason against a log: applied, skipped (its operation was applied before, or stands
    earlier in the batch) or refused.

    In each workspace the sequence goes on from the greatest number taken (skipped entries use theirs up too), from 1 in a
    new one. An entry is out of order if its number is taken, stands twice in the batch or has a gap before it. A plan with
    such an entry is refused, and so are the plans it interlaces with and all that come after, whose numbers now have a gap
    before them. The same entry sent again (its number taken by its own operation) is skipped and refuses nothing. Entries
    without a workspace, plan, number or key are refused by themselves.
    """
    whole = F.col("workspace").isNotNull() & F.col("plan_id").isNotNull() & F.col("seq").isNotNull() & F.col("op_key").isNotNull()
    rows, key = entries.filter(whole), ["workspace", "op_key"]
    count = rows.count()
    taken = log.filter("outcome <> 'refused'")
    heads = staged(taken.groupBy("workspace").agg(F.max("seq").alias("head")), "heads")
    applied = taken.filter("outcome = 'applied'")
    done = applied.select(*key, F.lit(True).alias("done"), F.col("seq").alias("done_at")).distinct()
    few = applied.limit(FEW + 1).count() <= FEW
    rows = (rows if few else dealt_by_rows(rows, count, *key)).join(heads, "workspace", "left").join(F.broadcast(done) if few else done, key, "left").withColumn("head", F.coalesce("head", F.lit(0)))
    resent = F.coalesce(F.col("done") & ((F.col("seq") == F.col("done_at")) | (F.col("seq") <= F.col("head"))), F.lit(False))
    old, new = rows.filter(resent), rows.filter(~resent)
    bads, plans, first_bad = faults(new, heads, count)
    new = new.join(first_bad, "workspace", "left")
    refused = F.coalesce(F.col("seq") >= F.col("bad"), F.lit(False))
    kept = new.filter(~refused).select(*entries.columns, "done")
    kept = (dealt_by_rows(kept, count, *key) if few else kept).withColumn("turn", F.row_number().over(Window.partitionBy("workspace", "op_key").orderBy("seq", "plan_id")))
    repeated = F.coalesce("done", F.lit(False)) | (F.col("turn") > 1)
    out = new.filter(refused).join(bads, ["workspace", "seq"], "left").join(plans, ["workspace", "plan_id"], "left")
    columns = entries.columns
    return (
        kept.select(*columns, F.when(repeated, "skipped").otherwise("applied").alias("outcome"), F.when(repeated, "ALREADY_APPLIED").alias("reason"))
        .unionByName(out.select(*columns, F.lit("refused").alias("outcome"), F.coalesce("why", "plan_why", F.lit("AFTER_REFUSED")).alias("reason")))
        .unionByName(old.select(*columns, F.lit("skipped").alias("outcome"), F.lit("ALREADY_APPLIED").alias("reason")))
        .unionByName(entries.filter(~whole).select(*columns, F.lit("refused").alias("outcome"), F.lit("INCOMPLETE").alias("reason")))
    )


def dealt_by_rows(frame: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame dealt by keys where its rows are many. Adaptive execution joins partitions by their bytes, and numbered keys pack
    so well that a task of them would not hold its rows; a small batch is left to it."""
    return dealt(frame, rows, *keys) if rows > PARTITION_ROWS else frame


def faults(new: DataFrame, heads: DataFrame, count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of new entries (about count of them) and the heads of their workspaces: numbers out of order (workspace, seq, why), plans
    with such (workspace, plan_id, plan_why), and the number from which a workspace's entries are refused (workspace, bad).

    Runs of plans that interlace share no number, so what lies in the first bad run or behind it is told by its number alone.
    Numbers are compared in bins; only workspaces with a fault are grouped by plan. The three are written to the shared
    folder, so that small ones are known to be small.
    """
    numbers = new.select("workspace", "seq", F.floor(F.col("seq") / WIDTH).alias("__bin")).filter("__bin IS NOT NULL")  # said here, as both readers are one exchange then
    numbers = dealt_by_rows(numbers, count, "workspace", "__bin")
    numbers = running_max(numbers, "workspace", "__bin", [F.col("seq")], "seq", "__last", own=False).join(heads, "workspace", "left").withColumn("head", F.coalesce("head", F.lit(0)))
    before = F.coalesce("__last", "head")
    after = F.lead("seq").over(Window.partitionBy("workspace", "__bin").orderBy("seq"))
    why = first_that((F.col("seq") <= F.col("head"), "SEQUENCE_TAKEN"), ((F.col("seq") == before) | (F.col("seq") == after), "SEQUENCE_REPEATED"), (F.col("seq") > before + 1, "SEQUENCE_GAP"), otherwise=None)
    bads = staged(numbers.select("workspace", "seq", why.alias("why")).filter("why IS NOT NULL").distinct(), "bads")
    plans = staged(new.select("workspace", "plan_id", "seq").join(bads, ["workspace", "seq"]).groupBy("workspace", "plan_id").agg(F.min("why").alias("plan_why")), "bad-plans")
    spans = new.join(plans.select("workspace").distinct(), "workspace", "left_semi").groupBy("workspace", "plan_id").agg(F.min("seq").alias("start"), F.max("seq").alias("end"))
    runs = islands(spans.withColumnRenamed("workspace", "key"), WIDTH, touching=True).withColumnRenamed("key", "workspace")
    first_bad = staged(runs.join(plans, ["workspace", "plan_id"], "left_semi").groupBy("workspace").agg(F.min("island").alias("bad")), "first-bad")
    return bads, plans, first_bad


def append(entries: DataFrame, number: int, path: str) -> None:
    """Judges a batch and writes it to its own folder. Batches come in the order of their numbers."""
    rows = judged(entries, read_log(entries.sparkSession, path, number))
    rows.select(*[c.split(" ")[0] for c in LOG.split(", ") if c != "batch long"]).write.mode("overwrite").parquet(f"{path}/batch={number}")


def follow(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of entries to the log, as far as it is there now."""
    return entries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, number: append(rows, number, path)).trigger(availableNow=True).start()


def assertions(log: DataFrame) -> DataFrame:
    """assertion_id, subject, object, status, valid_from, valid_to and superseded_by of the assertions that the log created.

    The first operation in the sequence that supersedes an assertion closes it, unless a CLOSE_VALIDITY did before; what
    was never created, or is closed before it is created, stays out.
    """
    made, ended = F.col("op") == "CREATE_ASSERTION", F.col("op").isin("SUPERSEDE_ASSERTION", "CLOSE_VALIDITY") & F.col("assertion_id").isNotNull()
    done = log.filter("outcome = 'applied'").filter(made | ended)
    key = ["workspace", "assertion_id"]
    # All that befalls an assertion is dealt once; an end counts only behind the first creation.
    rows = dealt_by_rows(done, done.count(), *key).withColumn("made_at", F.min(F.when(made, F.col("seq"))).over(Window.partitionBy(*key).orderBy("seq")))
    first = [F.min_by(c, F.when(made, F.col("seq"))).alias(c) for c in ("subject", "object", "at")]
    rows = rows.groupBy(*key).agg(*first, F.min("made_at").alias("made_at"), F.min(F.when(~made & (F.col("seq") > F.col("made_at")), F.struct("seq", "op", "other_id", "at"))).alias("e")).filter("made_at IS NOT NULL")
    status = first_that((F.col("e").isNull(), "ACTIVE"), (F.col("e.op") == "SUPERSEDE_ASSERTION", "SUPERSEDED"), otherwise="ENDED")
    return rows.select("workspace", "assertion_id", "subject", "object", status.alias("status"), F.col("at").alias("valid_from"), F.col("e.at").alias("valid_to"), F.when(F.col("e.op") == "SUPERSEDE_ASSERTION", F.col("e.other_id")).alias("superseded_by"))


def relations(log: DataFrame) -> DataFrame:
    """workspace, subject, object and assertion_id of projected relations whose assertion is in force."""
    shown = log.filter("outcome = 'applied' AND op = 'PROJECT_RELATION'").select("workspace", "assertion_id").distinct()
    return assertions(log).filter("status = 'ACTIVE'").join(shown, ["workspace", "assertion_id"]).select("workspace", "subject", "object", "assertion_id")
