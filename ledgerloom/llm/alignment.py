"""Alignment of two tokenizers' tokens over the same bytes, by elementary intervals.

The ends of both tokenizers' tokens, in bytes, are united; each interval between two of them has one token of either side
as its owner, and is one overlap of these two. An end that both share closes a group. Whole slices of texts are aligned
at a time: every text ends both sides, so texts laid one behind the other stay apart.

How often an id pair is linked is counted over the corpus:

1. A task gathers texts into blocks. It writes a block's distinct id pairs with their counts, and its texts as the
   numbers of their links' pairs, packed, to a table in the shared folder that lies bucketed by block.
2. Pairs are summed up over the blocks, and the highest count of each id of the second side (a row an id of its
   vocabulary) says which pairs are best.
3. The sums go back to the blocks that hold the pair, a row a pair and block, and each text adds up its links.

A pair that every text holds has one row a block, so no key is hot.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.bpe import encoding, expand, pack, read_ranks, unpack
from ledgerloom.llm.common import bucketed, slices, table

#: Characters after which a block ends; a longer text ends its block.
BLOCK_CHARS = 4_000_000
#: Characters of texts that are aligned at a time; a longer text goes alone.
SLICE_CHARS = 500_000
#: Pairs in a row of the table of blocks.
ROW_PAIRS = 20_000
#: Distinct words that a task remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: A word of the second tokenizer: its spaces and what follows. No piece goes on over the start of a word.
WORD = re.compile(r" +[^ ]*")
ROWS = "block long, place long, data binary, pairs array<long>, counts array<long>"
ROWS_ARROW = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("data", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
COLUMNS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "n_best": pa.int64(), "count_sum": pa.int64(), "groups_sha256": pa.string()}
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligned(NamedTuple):
    """Texts one behind the other: ids, the index of each link's tokens, and what each text and group has."""

    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray  # the group of each token
    group_b: np.ndarray
    n_a: np.ndarray  # by text
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of all elementary intervals and the owners of each: the first tokens that don't end before it does."""
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # union1d of two sorted arrays: merged, repeats left out
    ends = ends[np.diff(ends, prepend=-1) != 0]
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def products(group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of tokens that share a group: the coarser links of a group as a whole."""
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    each = n_a * n_b
    g = np.repeat(np.arange(len(each)), each)
    k = np.arange(len(g)) - np.repeat(np.cumsum(each) - each, each)
    return (np.cumsum(n_a) - n_a)[g] + k // n_b[g], (np.cumsum(n_b) - n_b)[g] + k % n_b[g]


class Pieces:
    """Ids of texts by a sentencepiece model whose pieces hold no space after another character: texts are cut into words,
    and each word that is remembered is encoded once. The model puts the space before the text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece of this model goes on over the start of a word")
        self.bytes = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
        self.space = self.model.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.counts, self.exact, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.uint32)

    def learn(self, words: list[str]) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        found = [ids if len(w) > 1 else [self.space] for w, ids in zip(words, self.model.encode([w[1:] for w in words], num_threads=1))]
        n = np.fromiter(map(len, found), np.int64, len(found))
        self.starts, self.counts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n]), np.concatenate([self.counts, n])
        self.exact = np.concatenate([self.exact, [self.joined(ids) == w.encode() for w, ids in zip(words, found)]])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))])

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, which starts with the space that the model would put there; None if their joined bytes are others."""
        if len(self.known) > REMEMBERED:
            self.forget()
        words = list(map(WORD.findall, texts))
        if new := set(chain.from_iterable(words)).difference(self.known):
            self.learn(list(new))
        out = []
        for text, each in zip(texts, words):
            numbers = np.fromiter(map(self.known.__getitem__, each), np.int64, len(each))
            ids = expand(numbers, self.starts, self.counts, self.ids)[0]
            out.append(ids if self.exact[numbers].all() or self.joined(ids.tolist()) == text.encode() else None)
        return out


class Aligner:
    """Aligns texts by a byte-level encoding (A) and a sentencepiece model (B)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        self.first, self.second = encoding(ranks, pattern), Pieces(model)
        self.size_a = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size_a[i] = len(token)
        self.size_b = np.array([len(x) for x in self.second.bytes], np.int64)
        # Every id as text with the sign that follows it in a list of groups.
        a, b = len(self.size_a), len(self.size_b)
        self.shown = [f"{i}{sign}" for n, signs in ((a, ",|"), (b, ",;")) for sign in signs for i in range(n)]
        self.after_a, self.after_b = (0, a), (2 * a, 2 * a + b)

    def align(self, texts: list[str | None]) -> Aligned:
        none = np.empty(0, np.uint32)
        found = iter(self.second.encode([f" {t}" for t in texts if t]))
        parts = []
        for text in texts:
            b = next(found) if text else None
            parts.append((none, none) if b is None else (self.first.encode_to_numpy(f" {text}", disallowed_special=()), b))
        n_a, n_b = (np.array([len(p[k]) for p in parts], np.int64) for k in (0, 1))
        a, b = (np.concatenate([none, *(p[k] for p in parts)]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends, link_a, link_b = overlaps(ends_a, ends_b)
        closes = (ends_a[link_a] == ends) & (ends_b[link_b] == ends) if len(ends) else np.empty(0, bool)
        group = np.cumsum(closes) - closes
        group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        group_a[link_a], group_b[link_b] = group, group
        till = np.concatenate([[0], ends_a])[np.cumsum(n_a)]  # the byte where each text ends
        each = lambda x: np.diff(np.searchsorted(x, till, "right"), prepend=0)
        return Aligned(a, b, link_a, link_b, group_a, group_b, n_a, n_b, each(ends[closes]), each(ends))

    def groups(self, x: Aligned) -> list[str]:
        """Each text's groups as a1,a2|b1;a3|b2,b3."""
        before = lambda g: np.concatenate([[0], np.cumsum(np.bincount(g))])  # noqa: E731  tokens before each group
        last = lambda g: np.diff(g, append=-1) != 0
        codes = np.empty(len(x.a) + len(x.b), np.int64)
        codes[np.arange(len(x.a)) + before(x.group_b)[x.group_a]] = x.a + np.where(last(x.group_a), self.after_a[1], self.after_a[0])
        codes[np.arange(len(x.b)) + before(x.group_a)[x.group_b + 1]] = x.b + np.where(last(x.group_b), self.after_b[1], self.after_b[0])
        bounds = np.concatenate([[0], np.cumsum(x.n_a + x.n_b)]).tolist()
        return ["".join(map(self.shown.__getitem__, codes[s:e].tolist()))[:-1] for s, e in zip(bounds, bounds[1:])]


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """doc_ids and texts of SLICE rows and SLICE_CHARS characters or so at most."""
    for batch in batches:
        for part in slices(batch):
            ids, texts, chars = [], [], 0
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                text = text.as_py()
                if ids and chars + len(text or "") > SLICE_CHARS:
                    yield ids, texts
                    ids, texts, chars = [], [], 0
                ids.append(i)
                texts.append(text)
                chars += len(text or "")
            yield ids, texts


def block_task(batches: Iterator[pa.RecordBatch], aligner: Aligner, links: str) -> Iterator[pa.RecordBatch]:
    """Rows of ROWS for rows (doc_id, text). Blocks have random names: the table that they are written to holds each once."""
    held, chars = [], 0

    def block():
        name = int.from_bytes(os.urandom(8), "little") >> 1
        pairs = np.concatenate([h[-1] for h in held])
        found, numbers, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # the most frequent pairs have the smallest numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        found, counts, at = found[order], counts[order], 0
        for k, (doc_ids, x, shas, p) in enumerate(held):
            null = np.array([i is None for i in doc_ids], np.uint32)
            ids = np.array([i or 0 for i in doc_ids], "<i8").view("<u4")
            sha = np.frombuffer(b"".join(bytes.fromhex(s).ljust(32, b"\0") for s in shas), "<u4")
            data = pack(ids, null, x.n_a, x.n_b, x.n_groups, x.n_links, sha, rank[numbers[at : at + len(p)]])
            at += len(p)
            yield pa.RecordBatch.from_pydict({"block": [name], "place": [-1 - k], "data": [data], "pairs": [None], "counts": [None]}, ROWS_ARROW)
        for s in range(0, len(found), ROW_PAIRS):
            yield pa.RecordBatch.from_pydict({"block": [name], "place": [s], "data": [None], "pairs": [found[s : s + ROW_PAIRS]], "counts": [counts[s : s + ROW_PAIRS]]}, ROWS_ARROW)

    for doc_ids, texts in text_slices(batches):
        x = aligner.align(texts)
        shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in aligner.groups(x)]
        if links == "product":
            link_a, link_b = products(x.group_a, x.group_b)
            x = x._replace(n_links=np.bincount(np.repeat(np.arange(len(texts)), x.n_a)[link_a], minlength=len(texts)))
        else:
            link_a, link_b = x.link_a, x.link_b
        pairs = x.a[link_a].astype(np.int64) << 32 | x.b[link_b]
        small = x._replace(**dict.fromkeys(("a", "b", "link_a", "link_b", "group_a", "group_b")))
        held.append((doc_ids, small, shas, pairs))
        chars += sum(len(t or "") for t in texts)
        if chars >= BLOCK_CHARS:
            yield from block()
            held, chars = [], 0
    if held:
        yield from block()


def add_up(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """A row a text of a block, from its links' pair numbers and what is known of the pairs."""
    numbers = answers.column("number").to_numpy()
    count, best = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    count[numbers], best[numbers] = answers.column("n").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False)
    out = []
    for data in texts.column("data").to_pylist():
        ids, null, n_a, n_b, n_groups, n_links, sha, links = unpack(data)
        bounds = np.concatenate([[0], np.cumsum(n_links.astype(np.int64))])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[links])])[bounds])
        raw = np.ascontiguousarray(sha).tobytes()
        shas = [raw[32 * k : 32 * k + 32].hex() if n else "" for k, n in enumerate(n_a)]
        values = [pa.array(ids.view("<i8"), pa.int64(), mask=null.astype(bool)), *(pa.array(v.astype(np.int64)) for v in (n_a, n_b, n_groups, n_links, total(best), total(count))), pa.array(shas)]
        out.append(pa.RecordBatch.from_arrays(values, schema=pa.schema(list(COLUMNS.items()))))
    return pa.Table.from_batches(out, pa.schema(list(COLUMNS.items())))


def align(documents: DataFrame, ranks: dict[bytes, int], pattern: str, model: bytes) -> DataFrame:
    """doc_id, a_ids, b_ids, and the tokens of each group (a_sizes, b_sizes) of every row of documents (doc_id, text).

    Both tokenizers encode a space and the text. Null and empty texts, and those whose joined bytes are others, have no
    tokens. Repeated rows and null doc_ids get rows of their own; other columns are ignored; no documents, no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast((ranks, pattern, model))  # two vocabularies

    def task(batches):
        aligner, kind = Aligner(*shared.value), pa.list_(pa.int32())
        for doc_ids, texts in text_slices(batches):
            x = aligner.align(texts)
            cut = lambda v, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(v, pa.int32()))
            sizes = [cut(np.bincount(g), x.n_groups) for g in (x.group_a, x.group_b)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), cut(x.a, x.n_a), cut(x.b, x.n_b), *sizes], schema=pa.schema([("doc_id", pa.int64()), ("a_ids", kind), ("b_ids", kind), ("a_sizes", kind), ("b_sizes", kind)]))

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text"))
    return docs.mapInArrow(task, "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


def link_counts(documents: DataFrame, ranks: dict[bytes, int], pattern: str, model: bytes, links: str = "overlap") -> DataFrame:
    """Tokens, groups, links, the links whose id pair is the most frequent one of its B id in the corpus (ties included),
    the sum of the links' corpus-wide counts, and the hash of the groups, of every row of documents (doc_id, text).

    links: "overlap" for pairs of tokens whose bytes overlap, "product" for all pairs of tokens of a group. Null and empty
    texts, and those whose joined bytes are others, have zeros and ''. Repeated rows and null doc_ids count and get rows of
    their own; other columns are ignored; no documents, no rows.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((ranks, pattern, model))  # two vocabularies
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text"))
    cut = bucketed(docs.mapInArrow(lambda x: block_task(x, Aligner(*shared.value), links), ROWS), "aligned", n, "block")
    held = cut.filter(F.col("place") >= 0).select("block", "place", F.posexplode(F.arrays_zip("pairs", "counts")))
    held = held.select("block", (F.col("place") + F.col("pos")).cast("int").alias("number"), F.col("col.pairs").alias("pair"), F.col("col.counts").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("n"))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    best = counts.groupBy(second.alias("b")).agg(F.max("n").alias("most"))  # a row an id of the vocabulary at most
    rated = counts.withColumn("b", second).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = held.select(F.col("block").alias("at"), "number", "pair").join(rated, "pair").select("at", "number", "n", "best")
    texts = cut.filter(F.col("place") < 0).select("block", "data")
    return texts.groupBy("block").cogroup(answers.groupBy("at")).applyInArrow(lambda t, a: add_up(t.select(["data"]), a), SCHEMA)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))  # the vocabulary of byte_bpe_50k.json
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return link_counts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, model)
