"""Token alignment, SimHash and sort-means: brute force, edge cases, and paths that small tables don't reach."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from ledgerloom.llm import alignment, centroids, simhash
from ledgerloom.llm.bpe import read_ranks
from ledgerloom.llm.common import join_skewed

TEXTS = [
    None, "", " ", "x  ", "\n\n a\tb", "<s> and <|endoftext|> are text", "é ﬁ ½ 　x 😀 ab", "a▁b", "\x00 a", "the cat the dog THE cat", "the cat the dog THE cat", "y" * 3000,
    "Lorem ipsum " * 200, "the <0x41> cat",
]


@pytest.fixture(scope="module")
def vocabularies():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, f.read()


def brute_alignment(texts, vocabularies):
    """Every pair of tokens of a text is tried."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=vocabularies[2])
    token = {i: t for t, i in vocabularies[0].items()}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()

    found = []
    for text in texts:
        a, b = (first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        if b"".join(map(piece, b)) != b"".join(map(token.__getitem__, a)):
            a, b = [], []
        ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] for x in ([token[i] for i in a], [piece(i) for i in b])]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])]
        groups, at = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, ee) if at < e <= end) for ids, ee in ((a, ends[0]), (b, ends[1]))))
            at = end
        found.append((len(a), len(b), groups, [(a[i], b[j]) for i, j in links]))
    counts = Counter(p for f in found for p in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (na, nb, len(g), len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for na, nb, g, p in found
    ]


def test_alignment_equals_brute_force(spark, vocabularies):
    texts = [t if t is None else t[:600] for t in TEXTS]
    docs = spark.createDataFrame([(None if k == 3 else k // 2, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, block string, n int")
    got = sorted(map(tuple, alignment.link_counts(docs, *vocabularies).collect()), key=str)
    want = sorted(((None if k == 3 else k // 2, *w) for k, w in enumerate(brute_alignment(texts, vocabularies))), key=str)
    assert got == want
    assert [r[1:4] for r in got if r[0] == 0] == [(0, 0, 0)] * 2
    assert alignment.link_counts(docs.limit(0), *vocabularies).count() == 0


def test_alignment_over_many_blocks_and_a_small_memory(spark, vocabularies, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = sorted(map(tuple, alignment.link_counts(docs, *vocabularies).collect()))
    for name, value in (("BLOCK_CHARS", 10), ("SLICE_CHARS", 5), ("ROW_PAIRS", 2), ("REMEMBERED", 3)):
        monkeypatch.setattr(alignment, name, value)
    assert sorted(map(tuple, alignment.link_counts(docs, *vocabularies).collect())) == want


def test_groups_and_products(spark, vocabularies):
    docs = spark.createDataFrame([(1, "tokenization of naïveté"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.align(docs, *vocabularies).collect()}
    assert rows[2].a_ids == rows[2].b_sizes == []
    assert sum(rows[1].a_sizes) == len(rows[1].a_ids) and sum(rows[1].b_sizes) == len(rows[1].b_ids)
    product = alignment.link_counts(docs, *vocabularies, links="product").filter("doc_id = 1").first()
    assert product.n_links == sum(a * b for a, b in zip(rows[1].a_sizes, rows[1].b_sizes))
    assert [x.tolist() for x in alignment.products(np.array([0, 0, 1]), np.array([0, 1, 1]))] == [[0, 1, 2, 2], [0, 0, 1, 2]]


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= simhash.DISTANCE:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_classes_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BITS", 7)  # bits are summed in several goes
    docs = spark.createDataFrame([(k if k != 4 else None, t, "x", 2) for k, t in enumerate(TEXTS)], "doc_id long, text string, fp string, n int")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_classes(docs).collect()}
    fps = [brute_fingerprint(t) for t in TEXTS]
    assert set(got) == {(k if k != 4 else None, f"{f:016x}") for k, f in enumerate(fps)}
    assert got[2, "0" * 16] == got[1, "0" * 16] == 0 and got[10, f"{fps[9]:016x}"] == 9
    assert simhash.near_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [4096, 8])
def test_hamming_components_equal_brute_force(spark, monkeypatch, bucket):
    """Two dense balls, one of them at zero, and scattered fingerprints; small buckets are partitioned again and again."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(5)
    near = lambda c, most: c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, most)))
    center = r.getrandbits(64)
    fps = list({near(0, 5) for _ in range(150)} | {near(center, 6) for _ in range(150)} | {r.getrandbits(64) for _ in range(200)})
    frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    links = [(a % 2**64, b % 2**64) for a, b in simhash.hamming_links(frame).collect() if a != b]
    assert all(bin(a ^ b).count("1") <= simhash.DISTANCE for a, b in links)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        root[find(a)] = find(b)
    want, got = brute_components(fps), [find(f) for f in fps]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got)))


def test_thresholds_follow_the_candidates():
    even = np.full(8 * 256, 1000)
    plan = simhash.allocate(even, 256_000)
    assert sum(t + 1 for _, _, t in plan) == simhash.DISTANCE + 1 and all(a[1] <= b[0] for a, b in zip(plan, plan[1:]))
    assert [e - s for s, e, t in simhash.allocate(even * 4000, 256_000 * 4000)] != [e - s for s, e, t in plan]  # more rows: wider partitions
    stuck = even.copy()
    stuck[: 2 * 256] = 0
    stuck[0] = stuck[256] = 256_000  # two octets say nothing: no partition lies in them alone
    assert all(e > 2 for _, e, _ in simhash.allocate(stuck, 256_000))


def test_join_skewed(spark, monkeypatch):
    from ledgerloom.llm import common

    monkeypatch.setattr(common, "HEAVY", 2)
    rows = spark.createDataFrame([(k % 5 if k < 40 else None, k) for k in range(42)], "key int, row int")
    values = spark.createDataFrame([(k, 10 - k, f"v{k}") for k in range(4)], "key int, n int, v string")
    assert sorted((r.row, r.v) for r in join_skewed(rows, values, "key", "n").collect()) == [(k, f"v{k % 5}") for k in range(40) if k % 5 < 4]


def vectors(seed, n):
    r = random.Random(seed)
    rows = [(k, [r.choice([-1.5, 0.0, 0.25, 2.0]) + r.random() for _ in range(64)], "x") for k in range(n)]
    rows += [(2, rows[2][1], "x"), (2, rows[2][1], "x"), (None, [0.5] * 64, None), (900, rows[1][1], "x"), (901, rows[1][1], "x")]
    return rows + [(902, None, "x"), (903, [0.5] * 63, "x"), (904, [float("nan")] + [0.5] * 63, "x"), (905, [None] + [0.5] * 63, "x"), (906, [float("-inf")] + [0.5] * 63, "x"), (907, [], "x")]


@pytest.mark.parametrize("n", [300, 3])
def test_centroids_equal_sql(spark, n):
    rows = vectors(n, n)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    got = centroids.with_inertia(*centroids.sort_means(frame)).collect()
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", [r[:2] for r in rows])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(centroids.OP13_SQL).fetchall()))
    assert centroids.with_inertia(*centroids.sort_means(frame.limit(0))).count() == 0


def test_scan_ends_only_beyond_ties():
    r = np.random.default_rng(3)
    x = r.integers(-2, 3, (2000, 64))
    x[:, 1:] = 0  # on a line: many ties
    c = np.zeros((5, 64), np.int64)
    c[:, 0] = [2, -2, 0, 2, 1]
    got = centroids.assign(x, r.integers(0, 5, 2000), c)
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (got[0] == d.argmin(1)).all() and (got[1] == d.min(1)).all()


def test_large_components_stop_the_job(spark):
    frame = spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.scaled(frame).collect()


def test_pages_of_a_host_with_a_tree_lose_what_the_tree_removes(spark, monkeypatch):
    """Declared parts are removed by their prior within the tree, comments too; a page of a host without a tree by the lists."""
    from ledgerloom.llm import html_extract as H

    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for k in range(24):
        article, comments, site = words(120), [words(12) for _ in range(k % 4)], "big.example" if k < 20 else "small.example"
        rare = "<div class='newsletter'>join us today</div>" if k == 3 else ""
        html = (
            f"<body><div class='nav'><a>Home</a><a>News</a></div><div class='x9'>all rights belong to us</div><div id='content'><h1>Title {k}</h1><p>{article}</p></div>{rare}"
            f"<div class='comments'>{''.join(f'<p>{c}</p>' for c in comments)}</div></body>"
        )
        rows.append((k, f"http://{site}/{k}", html))
        want[k] = f"Title {k} {article}" if site == "big.example" else f"all rights belong to us Title {k} {article}"
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda: {x.page_id: x.text for x in H.html_extract(frame).collect()}
    assert texts() == want
    removed = H.removed_branches
    monkeypatch.setattr(H, "removed_branches", lambda tree: removed(tree).filter(f"path = {H.HOST}"))
    off = texts()
    assert all((off[k] != want[k]) == (k < 20) for k in want)
    monkeypatch.setattr(H, "removed_branches", removed)
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(H, "HELD", 3)
    assert texts() == want
