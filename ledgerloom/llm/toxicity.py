"""Toxicity by a convolutional text classifier in numpy.

A word's vector is the sum of hashed embedding rows: the word's own and those of its beginnings, so unseen forms of a
word are near the known ones. Filters of several widths slide over the whole text, each keeps its maximum, and a
logistic layer weighs the maxima. The network is trained with Adam on all labelled documents: in each epoch every shard of
them trains the network of the epoch before, and what the shards have learned is averaged. The first embedding dimension
starts as the smoothed log odds of a word's documents, so training starts near a word-list classifier and learns
neighbourhoods from there. Thresholds are calibrated by language on all labelled rows that training did not see. Scoring
reads texts where they lie: no shuffle, and the model has a fixed size.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import map_slices, staged, table

BUCKETS, DIMENSIONS, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
#: Lengths of the beginnings of words that have embedding rows of their own.
BEGINNINGS = (4, 5, 6)
#: Labelled documents in a shard, about: a task goes through them one batch after another.
SHARD = 4000
#: Thresholds are read to one part in so many.
STEPS = 10_000
EPOCHS, BATCH, RATE, DECAY = 4, 32, 0.01, 1e-4
#: Parts of five of the labelled rows: 0 is held out from everything, 1 calibrates, the others train.
HELD_OUT, CALIBRATES = 0, 1
EMBEDDING_RATE = 0.5
#: Texts that are scored together.
TOGETHER = 200
WORD = re.compile(r"\w+")


def rows_of(word: str) -> list[int]:
    """Embedding rows of a word; row 0 stands for nothing."""
    hashed = lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1
    return [hashed("=" + word), *(hashed(word[:n]) if len(word) >= n else 0 for n in BEGINNINGS)]


def numbered(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Embedding rows of the distinct lower-cased words, and each text as places in that table. Place 0 is padding at both
    ends, so every filter fits."""
    known: dict[str, int] = {"": 0}
    pad, out = max(WIDTHS) - 1, []
    for text in texts:
        words = WORD.findall((text or "").lower())
        ids = np.zeros(len(words) + 2 * pad, np.int32)
        ids[pad : pad + len(words)] = [known.setdefault(w, len(known)) for w in words]
        out.append(ids)
    return np.array([[0] * (1 + len(BEGINNINGS)), *map(rows_of, list(known)[1:])], np.int32), out


class Network:
    """Embeddings, filters by width, and the output layer. Documents are arrays (word, embedding row)."""

    def __init__(self, having: np.ndarray, n: np.ndarray):
        """having: documents that hold an embedding row, by label and row; n: documents by label."""
        rng = np.random.default_rng(7)
        self.embedding = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
        odds = np.log((having[1] + 1) / (n[1] + 2)) - np.log((having[0] + 1) / (n[0] + 2))
        # A row of few documents says little, whatever its odds.
        self.embedding[:, 0] = odds * np.clip((having.sum(0) - 1) / 5, 0, 1) / 4
        self.embedding[0] = 0
        self.filters = {w: rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:
            self.filters[w][:, 0, : FILTERS // 2] += 1
        self.bias = np.full(FILTERS * len(WIDTHS), -0.5, np.float32)
        self.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.out_bias = np.float32(-2)

    def layers(self) -> np.ndarray:
        """All weights but the embedding's, in rows as long as its own."""
        flat = np.concatenate([*(self.filters[w].ravel() for w in WIDTHS), self.bias, self.out, [self.out_bias]])
        return np.pad(flat, (0, -len(flat) % DIMENSIONS)).reshape(-1, DIMENSIONS).astype(np.float32)

    def set_layers(self, rows: np.ndarray) -> None:
        flat, at = rows.ravel().astype(np.float32), 0
        for w in WIDTHS:
            self.filters[w] = flat[at : at + self.filters[w].size].reshape(self.filters[w].shape).copy()
            at += self.filters[w].size
        self.bias, self.out, self.out_bias = flat[at : at + len(self.bias)].copy(), flat[at + len(self.bias) : at + 2 * len(self.bias)].copy(), flat[at + 2 * len(self.bias)]

    def tables(self, rows: np.ndarray) -> dict[int, list[np.ndarray]]:
        """For each width, what each word of a table adds at each place of the filters."""
        vectors = self.embedding[rows].sum(1)
        return {w: [vectors @ f[k] for k in range(w)] for w, f in self.filters.items()}

    def score(self, ids: np.ndarray, tables: dict[int, list[np.ndarray]]) -> float:
        pooled = []
        for w, t in tables.items():
            n = len(ids) - w + 1
            best = np.full(FILTERS, -np.inf, np.float32)
            for lo in range(0, n, 4096):  # parts of the text, so that memory does not follow its length
                hi = min(n, lo + 4096)
                best = np.maximum(best, sum(t[k][ids[lo + k : hi + k]] for k in range(w)).max(0))
            pooled.append(best)
        return sigmoid(float(np.maximum(0, np.concatenate(pooled) + self.bias) @ self.out + self.out_bias))

    def step(self, batch: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, adam: "Adam") -> None:
        """One gradient step on the mean log loss of a batch of documents (embedding rows of its words, places among them)."""
        starts = np.concatenate([[0], np.cumsum([len(ids) for _, ids in batch])])
        words = np.concatenate([x for x, _ in batch])
        first = np.cumsum([0, *(len(x) for x, _ in batch[:-1])])
        rows = np.concatenate([ids + lo for (_, ids), lo in zip(batch, first)])
        vectors = self.embedding[words].sum(1)[rows]
        pooled, places = [], []
        for w in WIDTHS:
            conv = sum(vectors[k : len(rows) - w + 1 + k] @ self.filters[w][k] for k in range(w))
            at = np.stack([lo + conv[lo : hi - w + 1].argmax(0) for lo, hi in zip(starts, starts[1:])])
            places.append(at)
            pooled.append(np.take_along_axis(conv, at, 0))
        hidden = np.concatenate(pooled, 1) + self.bias
        active = np.maximum(0, hidden)
        error = (1 / (1 + np.exp(-(active @ self.out + self.out_bias))) - labels) / len(batch)
        back = np.outer(error, self.out) * (hidden > 0)
        grads = {"out": error @ active + DECAY * self.out, "out_bias": error.sum(), "bias": back.sum(0)}
        touched, changes = [], []
        for j, w in enumerate(WIDTHS):
            part = back[:, j * FILTERS : (j + 1) * FILTERS]
            for k in range(w):
                seen = vectors[places[j] + k]  # document, filter, dimension
                grads[w, k] = np.einsum("nf,nfd->df", part, seen) + DECAY * self.filters[w][k]
                change = (part[:, :, None] * self.filters[w][k].T[None]).reshape(-1, DIMENSIONS)
                touched.append(words[rows[places[j] + k]].reshape(-1, words.shape[1]))
                changes.append(change)
        adam.start()
        self.out -= adam.of("out", grads["out"])
        self.out_bias -= adam.of("out_bias", grads["out_bias"])
        self.bias -= adam.of("bias", grads["bias"])
        for w in WIDTHS:
            for k in range(w):
                self.filters[w][k] -= adam.of((w, k), grads[w, k])
        hit, change = np.concatenate(touched), np.concatenate(changes)
        for c in range(hit.shape[1]):
            np.subtract.at(self.embedding, hit[:, c], EMBEDDING_RATE * change)
        self.embedding[0] = 0


class Adam:
    def __init__(self):
        self.t, self.first, self.second = 0, {}, {}

    def start(self):
        self.t += 1

    def of(self, name, grad):
        m = self.first[name] = 0.9 * self.first.get(name, 0) + 0.1 * grad
        v = self.second[name] = 0.999 * self.second.get(name, 0) + 0.001 * np.square(grad)
        return (RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def place_type(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.int32


def read_rows(batch: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document as the embedding rows of its distinct words and the text as places among them."""
    tables = [np.frombuffer(x, np.uint16).reshape(-1, 1 + len(BEGINNINGS)) for x in batch["words"]]
    return [(t, np.frombuffer(i, place_type(len(t))).astype(np.int32)) for t, i in zip(tables, batch["ids"])]


def seeds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold an embedding row, by label and row, and documents by label, over all rows."""
    def count_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        having, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for x, y in zip(batch["words"], batch["toxic"]):
                having[y, np.unique(np.frombuffer(x, np.uint16))] += 1
                n[y] += 1
        hit = np.flatnonzero(having.sum(0))
        yield pd.DataFrame({"row": np.append(hit, -1), "clean": np.append(having[0, hit], n[0]), "toxic": np.append(having[1, hit], n[1])})

    found = rows.select("words", "toxic").mapInPandas(count_task, "row int, clean long, toxic long").groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    having, words = np.zeros((2, BUCKETS)), found[found["row"] >= 0]
    having[0, words["row"]], having[1, words["row"]] = words["clean"], words["toxic"]
    return having, found.loc[found["row"] == -1, ["clean", "toxic"]].to_numpy().reshape(-1, 2).sum(0)


def epoch(rows: DataFrame, network: Network) -> Network:
    """The network after all rows (words, ids, toxic): each task trains it on its own rows, a batch at a time, and sends what it
    changed. An embedding row is the mean of the tasks that changed it, the layers are the mean of all by documents."""
    names = [f"d{k}" for k in range(DIMENSIONS)]

    def train_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, adam, n = copy.deepcopy(network), Adam(), 0
        for batch in batches:
            for lo in range(0, len(batch), BATCH):
                piece = batch.iloc[lo : lo + BATCH]
                own.step(read_rows(piece), piece["toxic"].to_numpy(float), adam)
                n += len(piece)
        if n:
            hit, layers = np.flatnonzero((own.embedding != network.embedding).any(1)), own.layers()
            values = np.concatenate([own.embedding[hit], layers]).astype(float)
            weight = np.concatenate([np.ones(len(hit)), np.full(len(layers), float(n))])
            yield pd.DataFrame(values * weight[:, None], columns=names).assign(row=np.concatenate([hit, -1 - np.arange(len(layers))]), weight=weight)

    sums = rows.select("words", "ids", "toxic").mapInPandas(train_task, ", ".join(f"{c} double" for c in names) + ", row int, weight double")
    found = sums.groupBy("row").agg(*[(F.sum(c) / F.sum("weight")).alias(c) for c in names]).toPandas()
    after, kept = copy.deepcopy(network), found[found["row"] >= 0]
    after.embedding[kept["row"]] = kept[names].to_numpy(np.float32)
    after.set_layers(found[found["row"] < 0].sort_values("row", ascending=False)[names].to_numpy())
    return after


def calibrated(rows: DataFrame, network: Network) -> dict[str, float]:
    """The best threshold of each language over all rows (words, ids, toxic, lang), counted by score in STEPS steps."""
    def score_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = [network.score(ids, network.tables(words)) for words, ids in read_rows(batch)]
            yield pd.DataFrame({"lang": batch["lang"], "step": np.rint(np.array(scores) * STEPS).astype("int32"), "toxic": batch["toxic"]})

    found = rows.mapInPandas(score_task, "lang string, step int, toxic int").groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).toPandas()
    return {lang: best_threshold(x["step"].to_numpy() / STEPS, x["n"].to_numpy(), x["hits"].to_numpy()) for lang, x in sorted(found.groupby("lang"), key=lambda kv: kv[0])}


def best_threshold(scores: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The threshold with the best F1 over scores, each of n documents of which some are hits, in the middle of the gap that it
    lies in; 0.5 without both classes."""
    if not hits.sum() or hits.sum() == n.sum():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    found = np.cumsum(hits[order])
    k = int((2 * found / (np.cumsum(n[order]) + hits.sum())).argmax())
    below = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + below) / 2)


def part(doc_id) -> "F.Column":
    return F.crc32(F.col(doc_id).cast("string")) % 5


def fit(documents: DataFrame, labels: DataFrame) -> tuple[Network | None, dict[str, float]]:
    """The network and the thresholds by language, from all labels (doc_id, toxic) of documents (doc_id, text, lang).

    Of labelled rows, those held out are never looked at. A document labelled twice counts as toxic if one label says so.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(part("doc_id") != HELD_OUT)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = documents.filter(part("doc_id") != HELD_OUT).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("same"), "text", whole_lang(documents))
    # Copies would count as evidence: of equal texts the first document teaches. Only ids and hashes are grouped.
    known = texts.select("doc_id", "same").join(known, "doc_id").groupBy("same").agg(F.min(F.struct("doc_id", "toxic")).alias("first")).select("first.doc_id", "same", "first.toxic")
    known = staged(known, "labelled")
    shards = max(1, -(-known.count() // SHARD))

    def hashed_task(batches):
        for batch in batches:
            table_, ids = numbered(list(batch["text"]))
            places = [np.unique(x, return_inverse=True) for x in ids]
            yield batch[["doc_id", "lang", "toxic"]].assign(words=[table_[u].astype(np.uint16).tobytes() for u, _ in places], ids=[i.astype(place_type(len(u))).tobytes() for u, i in places])

    key = ["doc_id", "same"]
    rows = texts.repartition(shards, *key).join(known.repartition(shards, *key), key).dropDuplicates(key).sortWithinPartitions(F.xxhash64("doc_id"))
    rows = staged(map_slices(rows.select("doc_id", "lang", "toxic", "text"), hashed_task, "doc_id long, lang string, toxic int, words binary, ids binary"), "taught", compression="zstd")
    learns, calibrates = rows.filter(part("doc_id") != CALIBRATES), rows.filter(part("doc_id") == CALIBRATES)
    having, n = seeds(learns)
    if len(n) < 2 or not n.all():
        return None, {}
    network = Network(having, n)
    for _ in range(EPOCHS):
        network = epoch(learns, network)
    return network, calibrated(calibrates, network)


def whole_lang(documents: DataFrame):
    return F.coalesce(F.col("lang"), F.lit("")).alias("lang") if "lang" in documents.columns else F.lit("").alias("lang")


def sigmoid(x: float) -> float:
    return 1 / (1 + float(np.exp(-np.clip(x, -60, 60))))


RESULT = "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean"


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), threshold (of the row's language) and flagged (score >= threshold)
    of every row of documents (doc_id, text, lang).

    A score depends on the text alone. Null and empty texts get the score of no words. Languages without calibration rows
    have threshold 0.5. Without labels of both classes each score is 0. Repeated rows and null doc_ids (not held out) get
    rows of their own; other columns are ignored; no documents, no rows.
    """
    network, thresholds = fit(documents, labels)

    def score_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = np.zeros(len(batch))
            for lo in range(0, len(batch) if network else 0, TOGETHER):
                rows, ids = numbered(list(batch["text"][lo : lo + TOGETHER]))
                tables = network.tables(rows)
                score[lo : lo + TOGETHER] = [network.score(x, tables) for x in ids]
            least = np.array([thresholds.get(x, 0.5) for x in batch["lang"]], float)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": score, "predicted": (score >= 0.5).astype("int32"), "threshold": least, "flagged": score >= least})

    held = F.coalesce(part("doc_id") == HELD_OUT, F.lit(False)).alias("held_out")
    return documents.select(F.col("doc_id").cast("long"), "text", whole_lang(documents), held).mapInPandas(score_task, RESULT)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
