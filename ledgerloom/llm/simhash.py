"""Near duplicates by SimHash fingerprints within a Hamming distance, searched by the generalised pigeonhole principle.

If 64 bits are cut into partitions with thresholds whose sum of (threshold + 1) is the distance + 1, two fingerprints
within the distance differ by no more than the threshold in one partition at least (a threshold of -1 leaves a partition
out). Then:

1. Bits that are correlated are grouped into octets, from the counts of all distinct fingerprints.
2. The octets' values are counted; from these the number of pairs within t bits of each other is estimated for any run of
   octets and any t. Dynamic programming over octets and thresholds picks the cuts and thresholds, unequal in general,
   with the least cost of rows and candidates.
3. Each fingerprint goes to the buckets of its value in each partition and of all values within the threshold (probes).
4. Buckets that hold more than BUCKET rows are partitioned again by the bits outside their partition, in as many equal
   parts as the distance + 1, until none is larger. Two fingerprints of a bucket that are within the distance agree on one
   of these parts, so none is lost; the end comes because the bits left run out.
5. A bucket's links are verified by whole distances and only a forest of them leaves the task, not all pairs.

Equal fingerprints are one node throughout. The links' components come from rounds of joins over the forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import join_skewed, slices, staged, table
from ledgerloom.llm.components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Rows of a bucket that one task compares; larger ones are partitioned again.
BUCKET = 4096
#: Cost of a candidate pair, where a row that is moved costs 1.
PAIR_COST = 0.05
#: Shingles whose bits are counted at a time.
BITS = 1 << 14


def fingerprint(text: str | None) -> int:
    """The text's SimHash over its shingles, as a signed long."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[len(words) - n :].tolist())), "<u8", n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BITS):
        ones += np.unpackbits(hashes[k : k + BITS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (long) of every row of documents (doc_id, text). Null texts count as empty, whose fp is 0; other columns are
    ignored."""

    def task(batches):
        for batch in batches:
            for part in slices(batch):
                fps = [fingerprint(x.as_py()) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(task, "doc_id long, fp long")


def totals(fps: DataFrame, count, size: int) -> np.ndarray:
    """Sum over all fps of the vectors that count() makes of arrays of fps: a vector a task, summed by place."""

    def task(batches):
        sums = np.zeros(size, np.int64)
        for batch in batches:
            sums += count(batch.column("fp").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_pydict({"sums": [sums]}, pa.schema([("sums", pa.list_(pa.int64()))]))

    sums = fps.select("fp").mapInArrow(task, "sums array<long>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n"))
    out = np.zeros(size, np.int64)
    for pos, n in sums.collect():  # size rows at most
        out[pos] = n
    return out


def bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def together(x: np.ndarray) -> np.ndarray:
    """How often two bits are both set, for all pairs of bits."""
    out = np.zeros((64, 64), np.int64)
    for k in range(0, len(x), BITS):
        ones = bits(x[k : k + BITS]).astype(np.float32)
        out += (ones.T @ ones).astype(np.int64)
    return out.ravel()


def octets(both: np.ndarray, n: int) -> list[list[int]]:
    """The 64 bits in eight groups of eight: each starts with the first bit left and takes, one by one, the bit that is
    most correlated with those it has."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    likeness = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    left, out = list(range(64)), []
    while left:
        group = [left.pop(0)]
        while len(group) < 8:
            group.append(left.pop(int(np.argmax(likeness[np.ix_(left, group)].sum(1)))))
        out.append(group)
    return out


def mask_of(group: list[int]) -> int:
    return sum(1 << b for b in group)


def octet_values(x: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """How often each octet has each of its 256 values."""
    ones = bits(x)
    return np.concatenate([np.bincount(ones[:, g] @ (1 << np.arange(8)), minlength=256) for g in groups])


def allocate(values: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(first octet, octet behind the last, threshold) of each partition: least estimated cost by dynamic programming."""
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    share = values.reshape(8, 256) / max(n, 1)
    by_distance = [[float(h @ (apart == d) @ h) for d in range(DISTANCE + 1)] for h in share]  # of two random fps, for each octet

    def cost(s: int, e: int, t: int) -> float:
        near = np.zeros(DISTANCE + 1)
        near[0] = 1
        for o in range(s, e):
            near = np.convolve(near, by_distance[o])[: DISTANCE + 1]
        probes = sum(comb(8 * (e - s), k) for k in range(t + 1))
        return n * probes + PAIR_COST * n * n * near[: t + 1].sum()

    best: dict[tuple[int, int], tuple[float, list]] = {(8, 0): (0.0, [])}
    for s in range(7, -1, -1):
        for budget in range(DISTANCE + 2):
            found = [
                ((cost(s, e, t) if t >= 0 else 0.0) + best[e, budget - t - 1][0], [(s, e, t), *best[e, budget - t - 1][1]])
                for e in range(s + 1, 9) for t in range(-1, budget) if (e, budget - t - 1) in best
            ]
            if found:
                best[s, budget] = min(found)
    return [p for p in best[0, DISTANCE + 1][1] if p[2] >= 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(mask: int, t: int) -> list[int]:
    """All ways to change up to t bits of the mask."""
    places = [1 << b for b in range(64) if mask >> b & 1]
    return [signed(sum(c)) for k in range(t + 1) for c in combinations(places, k)]


def in_parts(mask: int) -> list[int]:
    """The mask's bits in DISTANCE + 1 parts as equal as can be."""
    places, n = [b for b in range(64) if mask >> b & 1], DISTANCE + 1
    return [mask_of(places[len(places) * k // n : len(places) * (k + 1) // n]) for k in range(n)]


def probes(fps: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """key, fp, path: a row for each bucket that a fingerprint goes to; parts are masks and thresholds."""

    def of(k: int, mask: int, t: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        return F.transform(F.array(*map(F.lit, flips(mask, t))), lambda x: F.struct(F.xxhash64(F.lit(k), own.bitwiseXOR(x)).alias("key"), F.lit(k).alias("path")))

    return fps.select("fp", F.explode(F.concat(*[of(k, m, t) for k, (m, t) in enumerate(parts)])).alias("to")).select("to.key", "fp", "to.path")


def refine(rows: DataFrame, free: list[list[int]]) -> DataFrame:
    """The rows' buckets partitioned again: free has for each path the masks of its parts."""
    n = DISTANCE + 1
    masks = F.array(*[F.lit(signed(m)) for parts in free for m in parts])
    found = rows.select("key", "fp", "path", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
    at = F.col("path") * n + F.col("part")
    return found.select(F.xxhash64("key", "part", F.col("fp").bitwiseAND(F.element_at(masks, at + 1))).alias("key"), "fp", at.cast("int").alias("path"))


def forest(x: np.ndarray) -> tuple[list, list]:
    """Links that connect whatever distinct fps within the distance connect: each node is reached once."""
    left, a, b = x, [], []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            p = reached.pop()
            near = np.bitwise_count(left ^ p) <= DISTANCE
            if near.any():
                found = left[near]
                left = left[~near]
                a += [p] * len(found)
                b += found.tolist()
                reached += list(found)
    return a, b


def link_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows sorted by key; only the bucket that is not yet complete is held over."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(keys, fps):
        edges = np.flatnonzero(np.diff(keys)) + 1
        bounds = np.concatenate([[0], edges, [len(keys)]])
        sizes = np.diff(bounds)
        a, b = [], []
        two = bounds[:-1][sizes == 2]  # the most common case, at once
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE]
        a += fps[near].tolist()
        b += fps[near + 1].tolist()
        for k in np.flatnonzero(sizes > 2):
            found = forest(np.unique(fps[bounds[k] : bounds[k + 1]]))
            a += found[0]
            b += found[1]
        arrays = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if done:
            yield links(keys[:done], fps[:done])
            keys, fps = keys[done:], fps[done:]
    if len(keys):
        yield links(keys, fps)


def hamming_links(fps: DataFrame) -> DataFrame:
    """a, b: links of distinct fps (fp long, no repeats) within DISTANCE bits that connect all that such links connect."""
    n = fps.count()
    if not n:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    groups = octets(totals(fps, together, 64 * 64).reshape(64, 64), n)
    plan = allocate(totals(fps, lambda x: octet_values(x, groups), 8 * 256), n)
    parts = [(mask_of(sum(groups[s:e], [])), t) for s, e, t in plan]
    rows, free = staged(probes(fps, parts), "probes"), [((1 << 64) - 1) & ~m for m, _ in parts]
    links = None
    while True:
        large = staged(rows.groupBy("key").count().filter(F.col("count") > BUCKET).select("key"), "large")
        small = rows.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "fp")
        found = small.select("key", "fp").mapInArrow(link_task, "a long, b long")
        links = found if links is None else links.union(found)
        if large.isEmpty():
            return links
        rows = staged(refine(rows.join(large, "key"), [in_parts(m) for m in free]), "probes")
        free = [m & ~p for m in free for p in in_parts(m)]


def near_classes(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links of DISTANCE bits or fewer reach) of
    every row of documents (doc_id, text).

    Texts without words, null ones too, have fingerprint zero and are linked like any other. Repeated rows get rows of
    their own; rows without a doc_id too, but they give their component no id: it is null if it has no other rows. Other
    columns are ignored; no documents, no rows.
    """
    docs = staged(fingerprints(documents), "fingerprints")
    nodes = staged(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(hamming_links(nodes.select("fp")))
    joined = staged(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n"), F.count("*").alias("nodes"))
    named = join_skewed(joined.select("fp", "root", F.col("n").alias("rows")), ids.select("root", "component_id", "nodes"), "root", "nodes")
    found = join_skewed(docs, named.select("fp", "component_id", "rows"), "fp", "rows")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
