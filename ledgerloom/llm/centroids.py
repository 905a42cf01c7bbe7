"""Centroid clustering by sort-means, exact over integers.

Each round the centroids are ordered by their distance from each centroid. A vector starts from the centroid it was
assigned to and scans the others in that centroid's order; once a centroid is strictly farther from the assigned one than
twice the vector's distance to it, the triangle inequality says that it and all behind it are farther from the vector too,
so the scan ends. Ties are never cut off, since only strictly greater distances end it.

Vectors are cut into blocks once, in a table of the shared folder that lies bucketed by block, so no round moves them
again; a round writes a byte a vector (its assignment) and a sum a centroid and task. Only the sums, a row a centroid and
component, go to the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import bucketed, staged, table

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Integers beyond it in a vector stop the job: squared distances would not fit in a long.
LIMIT = 1 << 27
#: Vectors in a block.
BLOCK = 4096
BLOCKS = "block long, ids binary, null_ids binary, vectors binary"
BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("null_ids", pa.binary()), ("vectors", pa.binary())])
ROUND = "at long, near binary, centroid int, n long, sums array<long>"
ROUND_ARROW = pa.schema([("at", pa.int64()), ("near", pa.binary()), ("centroid", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def scaled(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v, the components as integers floor(SCALE * x), of the vectors that have exactly SIZE components, none null
    or non-finite."""
    x = F.col(column).cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    kept = embeddings.select(F.col("vec_id").cast("long"), x.alias("x")).filter((F.size("x") == SIZE) & F.forall("x", finite))
    fits = F.forall("x", lambda e: F.abs(e * SCALE) < LIMIT)
    checked = F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("a component is too large for distances in a long")).cast("array<double>"))
    return kept.select("vec_id", F.transform(checked, lambda e: F.floor(e * SCALE).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least sha256 of "seed:vec_id" (a null vec_id as nothing), ties by the vector itself."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), SIZE)


def cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors; their names are random, and the table that they are written to holds each once."""
    for batch in batches:
        for part in (batch.slice(k, BLOCK) for k in range(0, batch.num_rows, BLOCK)):
            ids, v = part.column("vec_id"), part.column("v").flatten().to_numpy().astype("<i4")
            row = {
                "block": int.from_bytes(os.urandom(8), "little") >> 1, "ids": ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                "null_ids": np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes(), "vectors": v.tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], BLOCKS_ARROW)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, near: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (the smaller number of equal ones) and its squared distance, by a scan from near."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.argsort(apart, axis=1, kind="stable")  # the centroid itself, or one equal to it, is first
    own = squared(x, centroids[near])
    best, distance, active = near.copy(), own.copy(), np.arange(len(x))
    for rank in range(len(centroids)):
        other = order[near[active], rank]
        scanned = apart[near[active], other] <= 4 * own[active]  # distances compare as their squares do
        active, other = active[scanned], other[scanned]
        if not len(active):
            break
        d = squared(x[active], centroids[other])
        better = (d < distance[active]) | ((d == distance[active]) & (other < best[active]))
        best[active[better]], distance[active[better]] = other[better], d[better]
    return best, distance


def block_vectors(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, SIZE).astype(np.int64)


def round_task(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row a block with its assignments, and one a centroid with the sum of its vectors."""
    sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
    for batch in batches:
        near = batch.column("near")
        out = []
        for k, data in enumerate(batch.column("vectors")):
            x = block_vectors(data.as_py())
            before = near[k].as_py()
            best, _ = assign(x, np.frombuffer(before, np.uint8).astype(np.int64) if before else np.zeros(len(x), np.int64), centroids)
            np.add.at(counts, best, 1)
            for c in range(len(centroids)):
                sums[c] += x[best == c].sum(0)
            out.append({"at": batch.column("block")[k].as_py(), "near": best.astype(np.uint8).tobytes()})
        yield pa.RecordBatch.from_pylist(out, ROUND_ARROW)
    yield pa.RecordBatch.from_pylist([{"centroid": c, "n": int(counts[c]), "sums": sums[c].tolist()} for c in range(len(centroids)) if counts[c]], ROUND_ARROW)


def last_task(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            x = block_vectors(batch.column("vectors")[k].as_py())
            before = np.frombuffer(batch.column("near")[k].as_py(), np.uint8).astype(np.int64)
            best, distance = assign(x, before, centroids)
            null = np.unpackbits(np.frombuffer(batch.column("null_ids")[k].as_py(), np.uint8), count=len(x)).astype(bool)
            ids = pa.array(np.frombuffer(batch.column("ids")[k].as_py(), "<i8"), mask=null)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])


def sort_means(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept vector, and the final centroids.

    Vectors that are null, of other lengths, or hold null or non-finite components are left out; repeated rows count as
    often as they stand there, null vec_ids too; fewer vectors than k give fewer centroids; other columns are ignored; no
    vectors, no rows. Components of 131,072 or more (LIMIT) stop the job. At most 255 centroids.
    """
    spark = embeddings.sparkSession
    vectors = scaled(embeddings)
    centroids = first_centroids(vectors, k, seed)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(vectors.mapInArrow(cut_task, BLOCKS), "vectors", n, "block")
    near = None

    def joined() -> DataFrame:
        if near is None:
            return blocks.withColumn("near", F.lit(None).cast("binary"))
        # The blocks stay where they are: assignments, a byte a vector, are shuffled to them and held as a hash table.
        return blocks.join(near.hint("shuffle_hash"), blocks["block"] == near["at"])

    def one_round(centroids: np.ndarray) -> DataFrame:
        return staged(joined().select("block", "vectors", "near").mapInArrow(lambda b: round_task(b, centroids), ROUND), "round")

    for _ in range(rounds):
        found = one_round(centroids)
        sums = found.filter("centroid is not null").select("centroid", "n", F.posexplode("sums"))
        whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
        rows = sums.groupBy("centroid", "pos").agg(whole("n").alias("n"), whole("col").alias("total")).collect()  # k * SIZE rows
        centroids = centroids.copy()
        for r in rows:
            centroids[r["centroid"], r["pos"]] = int(r["total"]) // int(r["n"])
        near = found.filter("at is not null").select("at", "near")
    last = centroids
    held = joined().select("ids", "null_ids", "vectors", "near")
    return held.mapInArrow(lambda b: last_task(b, last), "vec_id long, cluster int, distance long"), last


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with the sums of distances of each cluster and of all (null if they don't fit in a long), and the hash of
    each cluster's centroid."""
    import hashlib

    spark = assigned.sparkSession
    assigned = staged(assigned, "assigned")
    exact = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()  # a row a centroid
    total = sum(int(r["inertia"]) for r in exact)
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(r["cluster"], fits(int(r["inertia"])), fits(total), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in exact]
    names = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*sort_means(table(spark, sf_dir, "embeddings")))



def _sql() -> str:
    """The query in DuckDB's SQL: a statement a round, every vector against every centroid."""
    parts = [f"""kept as materialized (
  select row_number() over (order by vec_id, v) as rid, vec_id, v from (
    select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
    where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {SIZE}))""",
        f"""c0 as materialized (
  select row_number() over (order by h, v) - 1 as c, v as m from (select sha256('{SEED}:' || coalesce(vec_id::varchar, '')) as h, v from kept)
  order by h, v limit {CENTROIDS})""",
        f"places as materialized (select unnest(range(1, {SIZE + 1})) as p)"]
    near = lambda r: f"""a{r} as materialized (
  select rid, c, d from (
    select rid, c, d, row_number() over (partition by rid order by d, c) as k from (
      select rid, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, c{r}))
  where k = 1)"""  # noqa: E731
    for r in range(ROUNDS):
        parts += [near(r), f"""s{r} as materialized (
  select c, p, sum(v[p])::hugeint as total, count(*) as n from a{r} join kept using (rid), places group by c, p)""",
            f"""c{r + 1} as materialized (
  select o.c, coalesce(x.m, o.m) as m from c{r} o left join (
    select c, list((case when total >= 0 then total // n else -((n - 1 - total) // n) end)::bigint order by p) as m from s{r} group by c) x using (c))"""]
    parts.append(near(ROUNDS))
    return "with " + ",\n".join(parts) + f"""
select vec_id, c::int as cluster, d as distance, sum(d) over (partition by c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
  sha256(array_to_string(m, ',')) as centroid_sha256
from a{ROUNDS} join kept using (rid) join c{ROUNDS} using (c)"""


OP13_SQL = _sql()
