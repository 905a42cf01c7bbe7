"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

1. Texts are cut into pre-tokens (words) with positions, once. A task gathers texts into blocks and writes two kinds of
   rows to a table in the shared folder: the block's distinct words, numbered by first use and packed by hash bucket, and
   its texts as the numbers of their words in order.
2. The words of all blocks are shuffled by bucket, so all uses of a word meet in one task, which encodes each distinct
   word of the whole corpus once and puts the ids beside the words' numbers.
3. The ids go back to their blocks' texts, which lie bucketed by block and so don't move, and each text's ids are put
   together by position.
4. Decoding looks each id up in the token-byte table, which has one row per rank, and so a size fixed by the vocabulary:
   the join's build side is broadcast and probed by place.

A row per pre-token and position would be many times the text, and one per word and block still more than the disk that
the job may take (2.1 x input); packed by bucket the words take some bytes each and the texts a byte and a half for each
pre-token. The cut is read back from its table, so a retried task or a source that deals its rows otherwise the next time
changes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import bucketed, slices, table

#: Characters after which a block ends; a longer text ends its block. A task holds one block's distinct words at a time.
BLOCK_CHARS = 8_000_000
#: Pre-tokens and texts after which a row of texts ends.
ROW_WORDS, ROW_TEXTS = 100_000, 500
#: Distinct words that a bucket's task remembers; beyond it the memory starts anew, and words are encoded again.
REMEMBERED = 500_000
#: The places of texts among a block's rows come after those of its words, which are their buckets.
TEXTS = 1 << 40
ROWS = "block long, place long, data binary"
ROWS_ARROW = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("data", pa.binary())])
IDS_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(ranks: dict[bytes, int], pattern: str = r"(?s:.+)"):
    """The encoding by these ranks. By default all of a text is one pre-token."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2**32 as one compressed value; bytes of equal weight stand together."""
    import zstandard

    out = [np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()]
    out += [np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:4].view("<u4")[0])
    sizes, at, out = raw[4 : 4 + 4 * n].view("<u4").tolist(), 4 + 4 * n, []
    for size in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 4 * size].reshape(4, size).T).view("<u4").ravel())
        at += 4 * size
    return out


def pack_texts(doc_ids: list[int | None], lengths: list[int], numbers: np.ndarray) -> bytes:
    """Texts as one value: their ids, which of these are null, their numbers of words, and the words' numbers."""
    ids = np.array([i or 0 for i in doc_ids], "<i8").view("<u4")
    return pack(ids, np.array([i is None for i in doc_ids], np.uint32), np.array(lengths, np.uint32), numbers)


def pack_words(numbers: list[int], words: list[str]) -> bytes:
    """Words and their numbers (rising) as one value."""
    return pack(np.diff(np.array(numbers, np.uint32), prepend=np.uint32(0)), np.frombuffer(json.dumps(words, ensure_ascii=False).encode(), np.uint8))


def unpack_words(data: bytes) -> tuple[np.ndarray, list[str]]:
    steps, text = unpack(data)
    return steps, json.loads(text.astype(np.uint8).tobytes())


def cut_task(batches: Iterator[pa.RecordBatch], pattern: str, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ROWS for rows of (doc_id, text). Blocks have random names: the table that they are written to holds each once."""
    import regex

    find = regex.compile(pattern).findall
    new_block = lambda: int.from_bytes(os.urandom(8), "little") >> 1
    block, place, chars = new_block(), TEXTS, 0
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    doc_ids, lengths, held, in_row = [], [], [], 0

    def row(at: int, data: bytes):
        return pa.RecordBatch.from_pydict({"block": [block], "place": [at], "data": [data]}, ROWS_ARROW)

    def texts_row():
        nonlocal place, doc_ids, lengths, held, in_row
        out = row(place, pack_texts(doc_ids, lengths, np.concatenate(held)))
        place, doc_ids, lengths, held, in_row = place + 1, [], [], [], 0
        return out

    def words_rows():
        buckets: dict[int, tuple[list, list]] = {}
        for word, number in numbers.items():
            of = buckets.setdefault(zlib.crc32(word.encode()) % n_buckets, ([], []))
            of[0].append(number)
            of[1].append(word)
        numbers.clear()
        for bucket in list(buckets):
            yield row(bucket, pack_words(*buckets.pop(bucket)))

    for batch in batches:
        for part in slices(batch):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                words = find(text or "")
                doc_ids.append(doc_id)
                lengths.append(len(words))
                held.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                chars += len(text or "")
                in_row += len(words)
                if in_row >= ROW_WORDS or len(lengths) >= ROW_TEXTS or chars >= BLOCK_CHARS:
                    yield texts_row()
                if chars >= BLOCK_CHARS:
                    yield from words_rows()
                    block, place, chars = new_block(), TEXTS, 0
    if doc_ids:
        yield texts_row()
    yield from words_rows()


def encode_task(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Puts ids in the place of words: (steps between numbers, ids of each word, all ids). A bucket's words are all here, so
    each is encoded once."""
    encode = encoding(ranks).encode_ordinary
    known: dict[str, list[int]] = {}
    for batch in batches:
        out = []
        for data in batch.column("data").to_pylist():
            if len(known) > REMEMBERED:
                known.clear()
            steps, words = unpack_words(data)
            for w in words:
                if w not in known:
                    known[w] = encode(w)
            found = [known[w] for w in words]
            out.append(pack(steps, np.fromiter(map(len, found), np.uint32, len(found)), np.fromiter(chain.from_iterable(found), np.uint32)))
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("place"), pa.array(out, pa.binary())], schema=ROWS_ARROW)


def assemble(texts: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a block's texts, from its texts and its words' ids."""
    tables = lookup([unpack(x) for x in words.column("data").to_pylist()])
    out = []
    for data in texts.column("data").to_pylist():
        doc_ids, null, lengths, numbers = unpack(data)
        found, n = expand(numbers, *tables)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found.astype(np.int32), pa.int32()))
        out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids.view("<i8"), pa.int64(), mask=null.astype(bool)), lists], schema=IDS_ARROW))
    return pa.Table.from_batches(out, IDS_ARROW)


def lookup(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each number's ids start, how many they are, and all ids, of the words of a block's buckets."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
    numbers = np.concatenate([np.cumsum(steps, dtype=np.int64) for steps, _, _ in parts])
    each = np.concatenate([n for _, n, _ in parts]).astype(np.int64)
    starts, counts = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
    starts[numbers], counts[numbers] = np.cumsum(each) - each, each
    return starts, counts, np.concatenate([ids for _, _, ids in parts])


def expand(numbers: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words with these numbers, one after the other, and how many each word has."""
    n = counts[numbers]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.arange(total) + np.repeat(starts[numbers] - (ends - n), n)], n


def bpe_encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row of documents (doc_id, text).

    Null and empty texts have no ids. Repeated rows and null doc_ids get rows of their own; other columns are ignored; no
    documents, no rows. No special tokens: a text that holds such a string is encoded as ordinary text. A row's text, or a
    row of texts with ROW_WORDS words or so, is what a task holds beside a block's distinct words.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # one entry per token of the vocabulary
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # packed rows: their bytes don't tell their work
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text"))
    cut = bucketed(docs.mapInArrow(lambda x: cut_task(x, pattern, n), ROWS), "cut", n, "block")
    words, texts = cut.filter(F.col("place") < TEXTS), cut.filter(F.col("place") >= TEXTS)
    ids = words.repartition(n, "place").mapInArrow(lambda x: encode_task(x, shared.value), ROWS)
    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded (bytes) and decoded_sha256 of rows (doc_id, ids).

    Null ids count as none. An id without a rank stops the job.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"]

    def decode_task(batches):
        token = [b""] * (max(shared.value.values(), default=-1) + 1)
        for b, i in shared.value.items():
            token[i] = b
        decimal = [str(i) if b else None for i, b in enumerate(token)]
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), part.column("ids")):
                    ids = ids.values.to_pylist() if ids.is_valid else []
                    text = b"".join(map(token.__getitem__, ids))
                    shown = " ".join(map(decimal.__getitem__, ids))
                    rows.append((doc_id, len(ids), hashlib.sha256(shown.encode()).hexdigest(), text, hashlib.sha256(text).hexdigest()))
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), pa.schema(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()))))

    return encoded.select("doc_id", "ids").mapInArrow(decode_task, "doc_id long, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe_decode(ids, ranks).drop("decoded")
