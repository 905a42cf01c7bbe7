"""Best-fit packing by length patterns and non-negative least squares.

Texts become token pieces of at most LENGTH (longer documents are cut). Only the histogram of piece lengths, at most
LENGTH numbers however many pieces there are, goes to the driver. There patterns of up to MAX_PIECES lengths that fill a
sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded down
to what the histogram still holds, and the residual lengths are packed by best fit. The plan says, for each length,
which of its pieces (by rank) go to which sequences and where. Ranks are dealt in two levels, so a length that a third
of all pieces share is not sorted in one task, and pieces join the plan by length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm.bpe import encoding, read_ranks
from ledgerloom.llm.common import map_slices, staged, table

LENGTH = 2048
#: Room that an enumerated pattern may leave; emptier ones are left to best fit, which can use more pieces.
ROOM = 8
#: Most pieces of an enumerated pattern.
MAX_PIECES = 3
#: Lengths, the most frequent, that are tried as the second piece of three.
MIDDLES = 24
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """ids of texts as the vocabulary's tokenizer gives them: special tokens' strings are those tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int]):
        self.plain, self.special = encoding(ranks, pattern), special
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.split and any(s in text for s in self.special):
            return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self.ids(x) for x in self.split.split(text))
        return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()


def cut(n: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or full ones behind a first that may be shorter."""
    if n <= LENGTH:
        return [(0, n)]
    first = n % LENGTH or LENGTH
    return [(0, first), *((s, LENGTH) for s in range(first, n, LENGTH))]


def pieces_task(batches: Iterator[pd.DataFrame], encoder: Encoder) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for i, c, text in zip(batch["doc_id"].astype("Int64"), batch["copy"], batch["text"]):
            data = encoder.ids(text or "") + bytes(4)
            rows += [(i, c, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(data) // 4))]
        yield pd.DataFrame(rows, columns=["doc_id", "copy", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})


def patterns(counts: np.ndarray) -> np.ndarray:
    """Rows of lengths, padded by 0, that sum to LENGTH or at most ROOM less."""
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths < LENGTH]
    if not len(lengths):
        return np.empty((0, MAX_PIECES), np.int64)
    below = lambda x: lengths[np.maximum(np.searchsorted(lengths, x, "right") - 1, 0)]  # noqa: E731  the longest that fits, or the shortest of all
    pairs = np.stack([lengths, below(LENGTH - lengths), np.zeros_like(lengths)], 1)
    middles = lengths[np.argsort(-counts[lengths], kind="stable")[:MIDDLES]]
    middles = np.union1d(middles, lengths[:: max(1, len(lengths) // MIDDLES)])
    a, b = (x.ravel() for x in np.meshgrid(lengths, middles))
    triples = np.stack([a, b, below(LENGTH - a - b)], 1)
    found = np.sort(np.concatenate([pairs, triples]), 1)[:, ::-1]
    return np.unique(found[(found.sum(1) <= LENGTH) & (found.sum(1) >= LENGTH - ROOM)], axis=0)


def fitted(counts: np.ndarray, rows: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring sum(x * pattern) near the histogram: projected gradient steps with
    momentum on 0.5 * |Ax - counts|^2, A's column of a pattern holding how often it has each length."""
    to_lengths = lambda x: np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), LENGTH + 1) * real
    real = np.ones(LENGTH + 1)
    real[0] = 0
    x = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue of A'A, for the step
        x = to_lengths(x)[rows].sum(1)
        top = np.linalg.norm(x)
        x /= top
    want = counts * real
    x, y, t = np.zeros(len(rows)), np.zeros(len(rows)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - ((to_lengths(y) - want) * real)[rows].sum(1) / (1.05 * top))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (was - 1) / t * (new - x), new
    return x


def plan(histogram: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset): pieces of that length with ranks from the first on go, one
    each, to as many sequences from the first on, at the offset. The list's size depends on LENGTH, not on the corpus."""
    counts = np.zeros(LENGTH + 1, np.int64)
    for n, k in histogram.items():
        counts[n] = k
    left, used, sequence, out = counts.copy(), np.zeros(LENGTH + 1, np.int64), 0, []

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequence
        at = 0
        for n in lengths:
            # a pattern that has a length twice takes two runs of ranks
            out.append((int(n), int(used[n]), int(times), sequence, at))
            used[n] += times
            left[n] -= times
            at += int(n)
        sequence += int(times)

    if left[LENGTH]:
        place([LENGTH], left[LENGTH])
    rows = patterns(counts)
    if len(rows):
        times = fitted(counts, rows)
        for k in np.argsort(-times, kind="stable"):
            lengths = [n for n in rows[k] if n]
            fit = min([int(times[k]), *(left[n] // lengths.count(n) for n in lengths)])
            if fit > 0:
                place(lengths, fit)
    # Residuals: the longest left goes first; the sequences of each shape it opens are filled by the best fit there is.
    present = [int(n) for n in np.flatnonzero(left)]
    while present:
        lengths, room, left_of = [], LENGTH, {}
        while True:
            k = bisect_left(present, room + 1) - 1
            while k >= 0 and left_of.get(present[k], left[present[k]]) == 0:
                k -= 1
            if k < 0:
                break
            n = present[k]
            left_of[n] = left_of.get(n, left[n]) - 1
            lengths.append(n)
            room -= n
        times = min(int(left[n]) // lengths.count(n) for n in set(lengths))
        place(lengths, times)
        present = [n for n in present if left[n]]
    return out


def pack(documents: DataFrame, ranks: dict[bytes, int], pattern: str, special: dict[str, int]) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of documents (doc_id, text).

    Null and empty texts are the end id alone. Rows that repeat a doc_id, or have none, are documents of their own. Other
    columns are ignored; no documents, no rows. Pieces are written once as a narrow table (no ids), from which the
    histogram, the ranks and the result are read.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # one entry per token of the vocabulary

    def cut_up(batches):
        return pieces_task(batches, Encoder(shared.value, pattern, special))

    docs = documents.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("copy"), F.col("text"))
    pieces = staged(map_slices(docs, cut_up, PIECES), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # LENGTH rows at most
    steps = spark.createDataFrame(plan(histogram) or [(0, 0, 0, 0, 0)], "length long, first long, times long, sequence long, at long")
    deal = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(deal)))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "deal").count().select("length", "deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "deal").orderBy("doc_id", "copy", "piece")
    ranked = (
        dealt.withColumn("within", F.row_number().over(within) - 1).join(offsets, ["length", "deal"])
        .withColumn("rank", F.col("within") + F.col("before"))
    )
    runs = steps.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "times", "sequence", "at"))).alias("runs"))
    placed = ranked.join(F.broadcast(runs), "length")  # LENGTH rows at most
    # The run with the greatest first rank that is not beyond the piece's.
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    return placed.withColumn("run", run).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.sequence") + F.col("rank") - F.col("run.first")).alias("sequence_id"), F.col("run.at").alias("offset"),
    )


def vocabulary() -> tuple[dict[bytes, int], str, dict[str, int]]:
    """Ranks, pattern and special tokens of the public byte-level vocabulary, whose two files hold the same tokens."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        added = json.load(f)["added_tokens"]
    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, {t["content"]: t["id"] for t in added}


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *vocabulary())
