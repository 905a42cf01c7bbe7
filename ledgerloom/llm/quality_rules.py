"""Quality rules: likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Words and pairs of neighbouring words are hashed into BUCKETS. Two multinomials over the buckets are estimated: one from
trusted documents, smoothed towards the other, one from all documents. A document's score is the mean over its
n-grams of log(p_target / p_raw), so length does not matter; it is kept if the score reaches THRESHOLD and the base
rules hold. Nothing is drawn at random, so a document has the same verdict in every run.

Both passes read the texts where they lie: the only shuffle is of bucket counts, summed up per task before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import tee

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import map_slices, slices, table
from ledgerloom.llm.words import Words

#: Buckets of the hashed n-grams; the model has this many numbers whatever the corpus.
BUCKETS = 1 << 17
#: Trusted rows that the target is estimated from, at most (those first by hash of doc_id).
TRUSTED_ROWS = 20_000
#: N-grams added to a bucket on both sides, in the raw corpus's proportions: a bucket seen a few times says little.
SMOOTHING = 5.0
#: Least mean log ratio of a document that stays.
THRESHOLD = -0.17
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    with np.errstate(over="ignore"):
        one = hashes * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        both = np.concatenate([one, two])
        both = (both ^ (both >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (both >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def n_repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found at least twice in the text."""
    if len(ids) < 4:
        return 0
    small = np.unique(ids, return_inverse=True)[1] if ids.max() >= 1 << 21 else ids
    if small.max() < 1 << 21:
        keys = (small[:-2] << 42) | (small[1:-1] << 21) | small[2:]
    else:
        pairs = np.unique(small[:-2] * (small.max() + 1) + small[1:-1], return_inverse=True)[1]
        keys = pairs * (small.max() + 1) + small[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    repeated = np.zeros(len(keys), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(keys)] |= repeated
    return int(covered.sum())


def n_dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def count_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per bucket that occurs in the task's texts."""
    words, raw, target = Words(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for trusted, sums in ((False, [raw]), (True, [raw, target])):
            waiting, n = [], 0
            for text in batch["text"][batch["trusted"] == trusted]:
                if text:
                    waiting.append(buckets(words.of(text)[1]))
                    n += len(waiting[-1])
                if n > 1_000_000:
                    add(waiting, sums)
                    waiting, n = [], 0
            add(waiting, sums)
    (there,) = raw.nonzero()
    yield pd.DataFrame({"bucket": there, "raw": raw[there], "target": target[there]})


def add(found: list[np.ndarray], sums: list[np.ndarray]) -> None:
    if found:
        counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
        for x in sums:
            x += counts


def fit(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) of each bucket. All documents count for the raw side, null texts have no words.

    Trusted are documents of label quality 1: the TRUSTED_ROWS of them first by hash. With none the ratio is 0 throughout.
    """
    trusted = (
        labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id")).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_ROWS).withColumn("trusted", F.lit(True))
    )
    marked = documents.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    rows = (
        map_slices(marked, count_task, "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .collect()  # at most BUCKETS rows
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def score_task(batches: Iterator[pd.DataFrame], ratio: np.ndarray, threshold: float) -> Iterator[pd.DataFrame]:
    words = Words()
    symbols = re.compile(f"[{re.escape(SYMBOLS)}]")
    for batch in batches:
        rows = []
        for text in batch["text"]:
            text = text or ""
            ids, hashes = words.of(text)
            n = len(ids)
            repeat = n_repeat_words(ids)
            score = float(ratio[buckets(hashes)].mean()) if n else 0.0
            failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
            chars = len(text) - sum(map(text.count, SPACES))
            rows.append((n, chars, len(symbols.findall(text)), n_dup_lines(text), repeat, failed, not failed and score >= threshold, score))
        columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
        out = pd.DataFrame(rows, columns=columns)
        out.insert(0, "doc_id", batch["doc_id"].array)
        yield out


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double"
)


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base verdict, score and verdict of every row of documents (doc_id, text) given labels (doc_id, quality).

    Words are runs without ASCII white space. Null and empty texts have no words and fail the base rules. Repeated rows
    get one row each; a null doc_id stays null. Other columns are ignored. Without documents there are no rows; without
    trusted labels every score is 0 and only the base rules decide.
    """
    ratio = fit(documents, labels)

    def scored(batches):
        return score_task(batches, ratio, threshold)

    return map_slices(documents.select(F.col("doc_id").cast("long"), F.col("text")), scored, RESULT)


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that the rules keep, with all their columns."""
    ratio = fit(documents, labels)

    def kept(batches):
        parts, ahead = tee(part for batch in batches for part in slices(batch))
        verdicts = score_task((part.select(["doc_id", "text"]).to_pandas() for part in ahead), ratio, threshold)
        for part, verdict in zip(parts, verdicts):
            yield part.filter(pa.array(verdict["kept"].to_numpy(bool)))

    return documents.mapInArrow(kept, documents.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
