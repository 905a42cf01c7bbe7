"""Decisions that depend on the order of what came before: rows of a key stream through one task, which holds one state.

A row that is refused leaves no trace, so no sum over all rows before it tells what the next one finds. A key's rows are
sorted by Spark, which spills, and walked once; a task's memory does not grow with them. A single key is walked by a
single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task holds as Python values at a time.
SLICE = 2000
#: Surfaces of a workspace that are walked together, on average.
TOGETHER = 16


def folded(rows: DataFrame, key: list[str], order: list[str], start: Callable[[], object], step: Callable, schema: str, end: Callable | None = None) -> DataFrame:
    """Walks each key's rows in order: step(state, row) gives the next state and the rows to emit; end(key, state) emits what
    a key leaves. Rows are dictionaries; nulls in a key are equal to each other."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                emitted = []
                for row in batch.slice(k, SLICE).to_pylist():
                    now = tuple(row[c] for c in key)
                    if at != now:
                        if at is not None and end:
                            emitted += end(at, state)
                        at, state = now, start()
                    state, some = step(state, row)
                    emitted += some
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, r)) for r in emitted], out)
        if at is not None and end:
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, r)) for r in end(at, state)], out)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(task, schema)


def admitted(requests: DataFrame, most_calls: int | None, most_cost: int | None) -> DataFrame:
    """request_id, admitted, calls and cost (what the run has used then) of requests (run, at, request_id, cost: whole units,
    kind: call, or refund of a call that was not made): in the order of `at` and request_id, a call is admitted if neither
    the number of calls nor the cost would pass its limit (null: none), and only then counts. A refund gives back a call
    and its cost, to no less than 0, and is always admitted. A null cost is one unit; requests without a run are one run."""
    def step(state: tuple[int, int], row: dict) -> tuple[tuple[int, int], list]:
        calls, cost = state
        units = 1 if row["cost"] is None else row["cost"]
        if row["kind"] == "refund":
            calls, cost, ok = max(0, calls - 1), max(0, cost - units), True
        else:
            ok = (most_calls is None or calls + 1 <= most_calls) and (most_cost is None or cost + units <= most_cost)
            calls, cost = (calls + 1, cost + units) if ok else (calls, cost)
        return (calls, cost), [(row["run"], row["request_id"], ok, calls, cost)]

    rows = requests.select(F.col("run").cast("string"), "at", F.col("request_id").cast("long"), F.col("cost").cast("long"), "kind")
    return folded(rows, ["run"], ["at", "request_id"], lambda: (0, 0), step, "run string, request_id long, admitted boolean, calls long, cost long")


MEMORY_KEY = ["workspace", "scope", "surface"]
#: Actions that fix what a surface means.
BINDING = ("LINK_EXISTING", "CREATE_NEW", "MERGE")


def memory(events: DataFrame, least: float = 0.0) -> DataFrame:
    """workspace, scope, surface, entity_id, confidence and resolution_id: what a memory holds after all events.

    events: at (their order in a workspace; ties go by event_id), event_id, kind, workspace, scope (null: shared), surface,
    entity_id, resolution_id, confidence, action. A record of a BINDING action, with an entity and `least` confidence,
    replaces what its surface means only by another entity that is strictly surer. forget_surface drops its surface's
    entry; forget_entity, forget_resolution and forget_workspace drop, in their workspace, the entries of the entity, those
    that the resolution made, and all. About TOGETHER surfaces of a workspace are walked together, however many it has, and
    each of these goes once to every such group that it can concern.
    """
    fits = (F.col("kind") == "record") & F.col("action").isin(*BINDING) & F.col("entity_id").isNotNull() & (F.col("confidence") >= least) & (F.coalesce("surface", F.lit("")) != "")
    columns = ["at", "event_id", "kind", "group", *MEMORY_KEY, "entity_id", "resolution_id", "confidence"]
    most = events.filter(fits).select(*MEMORY_KEY).distinct().groupBy("workspace").count().agg(F.max("count")).first()[0]
    group = F.pmod(F.xxhash64("scope", "surface"), F.lit(-(-(most or 1) // TOGETHER))).cast("int")
    records = events.filter(fits).withColumn("group", group).select(*columns)
    forgets = events.filter(F.col("kind").startswith("forget_")).withColumn("group", group)
    own = forgets.filter("kind = 'forget_surface'").select(*columns)
    parts = [records, own]
    for kind, by in (("forget_entity", ["workspace", "entity_id"]), ("forget_resolution", ["workspace", "resolution_id"]), ("forget_workspace", ["workspace"])):
        concerned = records.select(*dict.fromkeys(["workspace", "group", *by])).distinct()
        these = forgets.filter(F.col("kind") == kind).drop("group").join(concerned, by)
        parts.append(these.select(*columns))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def step(held: dict, row: dict) -> tuple[dict, list]:
        """held: entity, confidence and resolution by scope and surface."""
        key, kind = (row["scope"], row["surface"]), row["kind"]
        if kind == "record":
            now = held.get(key)
            if now is None or (row["entity_id"] != now[0] and row["confidence"] > now[1]):
                held[key] = (row["entity_id"], row["confidence"], row["resolution_id"])
        elif kind == "forget_surface":
            held.pop(key, None)
        elif kind == "forget_workspace":
            held.clear()
        else:
            at, value = (0, row["entity_id"]) if kind == "forget_entity" else (2, row["resolution_id"])
            for lost in [k for k, v in held.items() if v[at] == value] if kind in ("forget_entity", "forget_resolution") else ():
                del held[lost]
        return held, []

    schema = "workspace string, scope string, surface string, entity_id string, confidence double, resolution_id string"
    typed = rows.select("at", "event_id", "kind", "group", *[F.col(c).cast("string") for c in (*MEMORY_KEY, "entity_id", "resolution_id")], F.col("confidence").cast("double"))
    return folded(typed, ["workspace", "group"], ["at", "event_id"], dict, step, schema, lambda key, held: [(key[0], *k, *v) for k, v in held.items()])


def recalled(mentions: DataFrame, held: DataFrame) -> DataFrame:
    """mention_id, entity_id and source of mentions (mention_id, workspace, scope, surface) by a memory: their own scope's
    entry, else the shared one; the shared scope (null) never sees another's."""
    own = held.filter("scope IS NOT NULL").select("workspace", "scope", "surface", F.col("entity_id").alias("own"))
    shared = held.filter("scope IS NULL").select("workspace", "surface", F.col("entity_id").alias("common"))
    rows = mentions.join(own, ["workspace", "scope", "surface"], "left").join(shared, ["workspace", "surface"], "left")
    source = F.when(F.col("own").isNotNull(), "own").when(F.col("common").isNotNull(), "shared").otherwise("none")
    return rows.select("mention_id", F.coalesce("own", "common").alias("entity_id"), source.alias("source"))
