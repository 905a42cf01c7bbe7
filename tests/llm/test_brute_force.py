"""Operators that SQL cannot express, held against plain Python over whole small tables."""

import collections
import hashlib
import os
import re
import time
import zlib

import pytest
import regex

from ledgerloom.llm import bpe, html_extract, line_dedup, near_dedup, packing, pii, registry

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@needs_tables
def test_bpe_ids_and_bytes(spark, texts):
    import public_tokenizers as P

    enc = bpe.encoding(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    got = registry.queries()["op5_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        ids = [i for w in regex.findall(P.PATTERN, text) for i in enc.encode_ordinary(w)]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_rows_of_many_blocks(spark, monkeypatch):
    import pyarrow as pa

    rows = [(k if k % 7 else None, f"word{k % 13} {'x ' * (k % 5)}the end\n") for k in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    for name, value in (("BLOCK_CHARS", 500), ("ROW_WORDS", 20), ("ROW_TEXTS", 3)):
        monkeypatch.setattr(bpe, name, value)
    cut = pa.Table.from_batches(list(bpe.cut_task(iter([batch]), r"\w+|\s|[^\w\s]", 5)))
    ranks = {bytes([b]): b for b in range(256)}
    found = []
    blocks = set(cut["block"].to_pylist())
    for block in blocks:
        mine = [r for r in cut.to_pylist() if r["block"] == block]
        words = pa.RecordBatch.from_pylist([r for r in mine if r["place"] < bpe.TEXTS], bpe.ROWS_ARROW)
        ids = pa.Table.from_batches(list(bpe.encode_task(iter([words]), ranks)))
        found += bpe.assemble(pa.Table.from_pylist([r for r in mine if r["place"] >= bpe.TEXTS], bpe.ROWS_ARROW), ids).to_pylist()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(blocks) > 5 and sorted(((r["doc_id"], bytes(r["ids"]).decode()) for r in found), key=key) == sorted(rows, key=key)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


@needs_tables
def test_line_dedup(spark, texts):
    first, places = {}, []
    for i in sorted(texts):
        for n, line in enumerate((texts[i] or "").split("\n")):
            places.append((i, n, line))
            if re.search(r"[^\x20\x09-\x0D]", line):
                first.setdefault(line, (i, n))
    order = sorted(first, key=first.get)
    words = {x: x.split(" ") for x in order}
    long = collections.defaultdict(list)
    gone = set()
    for x in order:
        n = len(words[x])
        if n >= line_dedup.MIN_WORDS:
            if any(one_edit(words[x], words[y]) for m in (n - 1, n, n + 1) for y in long[m]):
                gone.add(x)
            long[n].append(x)
    want = collections.Counter(i for i, n, line in places if line in first and (first[line] != (i, n) or line in gone))
    got = {r.doc_id: r.n_dropped for r in registry.queries()["op3_line_dedup"](spark, SF).collect()}
    assert got == {i: want[i] for i in texts} and sum(want.values()) > 20 and gone


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text, re.A) if ok(m[0])]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


@needs_tables
def test_pii_base_spans(spark, texts):
    got = registry.queries()["op8_pii"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(",")) and r.n_email == base.count("email:")


@needs_tables
def test_packing(spark, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in registry.queries()["op10_best_fit_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at, total = 0, total + len(ids)
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            part = ids[r.start : r.start + r.length]
            assert (r.piece, r.start, r.length) == (k, at, len(part)) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r.length
        assert at == len(ids) and len(pieces[i]) == -(-len(ids) // packing.LENGTH)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    assert len(sequences) <= 1.05 * -(-total // packing.LENGTH) + 1


@needs_tables
def test_near_dedup_is_weighted(spark, texts):
    """Shingles count as often as they occur: classes by the weighted similarity, and a text that tells another twice."""
    bags = {}
    for i, text in texts.items():
        w = (text or "").encode().split()
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in bags:
        for b in bags:
            if a < b and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: r.class_id for r in registry.queries()["op4_minhash_near_dedup"](spark, SF).collect()} == {i: find(i) for i in bags}
    once = " ".join(f"w{k}" for k in range(50))
    rows = spark.createDataFrame([(1, once), (2, f"{once} {once} {once}")], "doc_id long, text string")
    count = lambda how: near_dedup.near_dedup(rows, weights=how).select("class_id").distinct().count()
    assert (count("count"), count("set")) == (2, 1 if 46 / 54 >= 0.8 else 2)


def page(k, words):
    menu = "".join(f"<li><a href=/{k}{j}>m{k} {j}</a></li>" for j in range(4))
    body = "".join(f"<p>word{k} {' '.join(f'w{k}x{j}' for j in range(n))}</p>" for n in words)
    return f"<div class=q1><ul>{menu}</ul></div><div class=q2>buy{k} this{k} now{k % 3}</div><div class=q3>{body}</div><div class=q4>same on every page</div>"


def test_style_trees_tell_articles_from_what_frames_them(spark):
    """No tag, class or role declares anything here, and menus and adverts have other words on each page."""
    import random

    rng = random.Random(5)
    lengths = [[rng.randrange(3, 60) for _ in range(rng.randrange(1, 9))] for _ in range(40)]
    rows = [(k, f"http://h.example/{k}", page(k, n), "x") for k, n in enumerate(lengths)]
    frame = spark.createDataFrame([*rows, rows[3], (99, "http://small.example/", page(99, [5]), "x")], "page_id long, url string, html string, removed string")
    got = {r.page_id: r.text for r in html_extract.html_extract(frame).collect()}
    for k, n in enumerate(lengths):
        assert got[k] == " ".join(f"word{k} {' '.join(f'w{k}x{j}' for j in range(m))}" for m in n)
    assert "same on every page" in got[99]  # one page says nothing about its host


def test_html_with_stray_quotes_and_long_pages_takes_linear_time():
    for bad in ("<a href=\"" * 20_000, "<p class='" * 20_000, "<!x " * 20_000, "<div " * 20_000, "x" * 2_000_000, "<b>" * 3_000 + "deep"):
        start = time.time()
        html_extract.blocks(bad)
        assert time.time() - start < 20
