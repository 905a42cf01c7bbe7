"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names for every operator and stage."""

import hashlib
import re
import zlib

import pytest

import corpus_pipeline
from ledgerloom.llm import bpe, chat_format, exact_dedup, html_extract, line_dedup, near_dedup, packing, pii, quality_rules, toxicity
from ledgerloom.llm.common import staged

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
PROSE = " ".join(f"word{i} then{i % 7}" for i in range(60))
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, PROSE, "en", "s", 1), (5, PROSE, "de", None, 1), (6, PROSE + " more", "en", "s", 1),
    (7, "x" * 30_000, "en", "s", 1), (8, "ä € 😀 <|endoftext|> a@b.cd\n" + PROSE, "en", "s", 1), (8, "ä € 😀 <|endoftext|> a@b.cd\n" + PROSE, "en", "s", 1), (None, "no id", None, "s", 5),
]
MARKS = [(4, 1, 0), (5, 1, 1), (6, 0, 1), (7, 0, 0), (8, 1, 0), (9, 1, 1), (10, 0, 0), (None, 1, 1), (5, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, "t") for r in ODD], DOCS + ", label int, title string").withColumnsRenamed({"label": "count", "title": "key"})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(MARKS, LABELS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_exact_dedup(docs, none):
    got = by_id(exact_dedup.exact_dedup(docs))
    assert sum(map(len, got.values())) == len(ODD)
    assert (got[1][0].keep_id, got[1][0].group_size, got[1][0].kept) == (1, 2, True) and got[2][0].keep_id == 1
    assert got[3][0].keep_id == 3 and got[3][0].text_sha256 == hashlib.sha256(b" ").hexdigest()
    assert [got[4][0].keep_id, got[5][0].keep_id, got[5][0].kept, got[6][0].kept] == [4, 4, False, True]
    assert [r.kept for r in got[8]] == [True, True] and got[None][0].kept
    assert exact_dedup.exact_dedup(none).count() == 0


def test_chunks_join_to_the_text(spark):
    text = "\n".join(PROSE[k:] for k in range(0, 400, 3)) + "y" * 20_000
    rows = spark.createDataFrame([(text,)], "t string").select(exact_dedup.chunks(exact_dedup.F.col("t")).alias("c"))
    parts = rows.first()["c"]
    assert "".join(parts) == text and max(map(len, parts)) <= exact_dedup.MAX_CHUNK and len(parts) > 10


def test_quality_rules(docs, labels, none):
    got = by_id(quality_rules.quality_rules(docs, labels))
    assert got[1][0].n_words == got[2][0].n_words == got[3][0].n_words == 0 and got[1][0].base_failed and not got[1][0].kept
    assert got[4][0].n_words == 120 and got[7][0].word_chars == 30_000 and got[8][0].n_symbols == 4 and len(got[8]) == 2
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert quality_rules.keep_good(docs, labels).columns == docs.columns
    assert all(r.score == 0 for r in quality_rules.quality_rules(docs, labels.limit(0)).collect())


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1}
    repeat = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)


def test_quality_counts_equal_brute_force(spark, labels):
    texts = [None, "a b c a b c d", "x x x x", "l1 w\nl1 w\n \n \nl1 w", "é\u00a0b #$ c\x1cd", "a b c\na b c " * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.quality_rules(rows, labels).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])


def test_line_dedup(spark, docs, none):
    got = by_id(line_dedup.line_dedup(docs))
    assert sum(map(len, got.values())) == len(ODD)
    assert got[1][0].text is None and got[2][0].text == "" and got[3][0].text == " \n\t "
    assert got[4][0].n_dropped == 0 and got[5][0].text == "" and got[6][0].text == ""  # equal, and one word more
    assert [r.text for r in got[8]] == ["ä € 😀 <|endoftext|> a@b.cd"] * 2
    assert line_dedup.line_dedup(none).count() == 0
    assert set(line_dedup.line_dedup(docs).columns) == {*docs.columns, "n_dropped"}


def test_line_edits(spark):
    base = "one two three four five six seven eight nine"
    lines = [base, base.replace("four", "FOUR"), base.replace("two ", ""), base + " ten", "a b c", "a b d", base.replace("one", "1").replace("nine", "9"), ""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.line_dedup(rows).filter("n_dropped > 0").collect()}
    assert gone == {1, 2, 3}


def test_near_dedup(docs, none):
    got = by_id(near_dedup.near_dedup(docs))
    assert sum(map(len, got.values())) == len(ODD)
    assert got[1][0].class_id == got[2][0].class_id == got[3][0].class_id == 1
    assert {got[k][0].class_id for k in (4, 5, 6, 8)} == {4} and got[4][0].class_size == 5 and got[7][0].class_size == 1
    assert near_dedup.near_dedup(none).count() == 0
    one = near_dedup.keep_one(docs)
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == ["1", "4", "7", "None"]


def test_near_dedup_tells_texts_under_one_doc_id_apart(spark):
    other = " ".join(f"thing{i} and{i % 5}" for i in range(60))
    texts = [(3, PROSE), (3, other), (3, other), (3, "short"), (4, other + " more"), (5, PROSE + " more"), (42, "a b"), (None, None), (None, "a b")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = near_dedup.near_dedup(rows).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.class_id, []).append((r.doc_id, r.class_size, r.kept))
    found = sorted((str(sorted(r[0] or 0 for r in c)), {r[1] for r in c}, sorted((r[0] or 0) for r in c if r[2])) for c in sizes.values())
    assert [x[:2] for x in found] == [("[0, 42]", {2}), ("[0]", {1}), ("[3, 3, 4]", {3}), ("[3, 5]", {2}), ("[3]", {1})]
    assert [x[2] for x in found][1:] == [[0], [3, 3], [3], [3]]
    assert 3 in sizes
    left = [tuple(r) for r in near_dedup.keep_one(rows).collect()]
    assert len(left) == 5 and {(3, PROSE), (3, other), (3, "short"), (None, None)} <= set(left)


def test_only_links_leave_a_comparison():
    import numpy as np
    import pandas as pd

    def links(*sets, classes=None):
        held = [np.sort(x.astype(np.uint32)).tobytes() for x in sets]
        ids = list(range(1, len(sets) + 1))
        rows = pd.DataFrame({"key": 1, "low": 0, "high": 0, "id": ids, "class": classes or ids, "shingles": held})
        return sorted(map(tuple, pd.concat([*near_dedup.compare_task(iter([rows]), 0.8), pd.DataFrame()]).to_numpy().tolist()))

    rng = np.random.default_rng(1)
    for n in (9, 900, 90_000):
        # Of 10 * n shingles two sets share 8 * n: exactly 0.8; one fewer is too few.
        x = np.unique(rng.integers(0, 1 << 32, 12 * n))[: 10 * n]
        x = rng.permutation(x[: len(x) // 10 * 10])
        n10 = len(x) // 10
        a, b = x[: 9 * n10], np.concatenate([x[: 8 * n10], x[9 * n10 :]])
        assert links(a, b) == [(2, 1)] and links(a, b[1:]) == [] and links(a, b, classes=[5, 5]) == []
    same = [a, a, a, a]
    assert len(links(*same)) == 3


def test_signatures_estimate_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = rng.uniform(0.2, 4, 60), rng.uniform(0.2, 4, 60)
    agree = []
    for shift in range(40):
        y = near_dedup.mix(x + np.uint64(shift))
        agree.append((near_dedup.signature(y, a) == near_dedup.signature(y, b)).mean())
    assert abs(np.mean(agree) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_bpe(spark, docs, none):
    import public_tokenizers as P

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = bpe.encoding(ranks, P.PATTERN)
    want = sorted((r[1] or "", len(enc.encode_ordinary(r[1] or ""))) for r in ODD)
    got = bpe.bpe_decode(bpe.bpe_encode(docs, ranks, P.PATTERN), ranks).collect()
    assert sorted((r.decoded.decode(), r.n_tokens) for r in got) == want
    assert bpe.bpe_decode(bpe.bpe_encode(none, ranks, P.PATTERN), ranks).count() == 0


def test_html(spark):
    page = "<html><body><nav>menu</nav><article class=x><h1>T &amp; x</h1><p>a\n b<b>c</b><p>d<div class='share'>s</div><!-- no --></article><div id=comments>c</div>"
    filler = [(i, f"http://h.org/{i}", f"<div class='blurb'>always the same</div><div class='body'>text {i}</div>") for i in range(2, 20)]
    rows = spark.createDataFrame([(0, None, None), (1, "http://a.b/c", page), (1, "http://a.b/c", page), (None, "odd", "plain")] + filler, "page_id long, url string, html string")
    got = html_extract.html_extract(rows).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 22 and text[0] == "" and text[1] == "T & x a bc d" and text[None] == "plain" and text[5] == "text 5"
    assert html_extract.html_extract(rows.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a <|done|>\n\\ [INST]"), (1, 1, "assistant", "b</s>"), (1, 1, "assistant", "b</s>"), (2, 0, None, None), (None, 0, "assistant", "x" * 2000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.chat_format(chat_format.as_events(frame)).collect()}
    assert chat_format.read_back(got[1].formatted) == [(r[2], r[3]) for r in rows[:3]] and chat_format.read_back(got[2].formatted) == [("", "")]
    loss = lambda r: [chat_format.unescape(r.formatted[m.start : m.end]) for m in r.loss_mask]
    turns = [("us\ner", "hi\\n"), ("\\n|<|", "x"), ("assistant", "\\\n")]
    assert chat_format.read_back(chat_format.render(turns)[0]) == turns
    assert loss(got[1]) == ["b</s>", "b</s>"] and loss(got[None]) == ["x" * 2000]
    assert chat_format.chat_format(chat_format.as_events(frame.limit(0))).count() == 0


def test_chat_folds_edits_and_regenerations(spark):
    log = [(1, 1, "start", 1, "user", ""), (1, 2, "delta", 1, "user", "hi"), (1, 3, "start", 2, "assistant", "he"), (1, 4, "delta", 2, "assistant", "y"), (1, 5, "regenerate", 2, "assistant", None), (1, 6, "delta", 2, "assistant", "hello"), (1, 7, "edit", 1, "user", "hi!")]
    frame = spark.createDataFrame(log[::-1], chat_format.EVENTS)
    assert chat_format.read_back(chat_format.chat_format(frame).first()["formatted"]) == [("user", "hi!"), ("assistant", "hello")]


def test_pii(spark, docs, none):
    got = by_id(pii.find_pii(docs))
    assert [r.spans for r in got[1] + got[2]] == [[], []] and len(got[8]) == 2
    assert [(s.start, s.end) for s in got[8][0].base] == [(20, 26)]
    assert pii.find_pii(none).count() == 0 and pii.redact(none).count() == 0
    out = pii.redact(docs)
    assert out.columns == docs.columns and by_id(out)[8][0].text.startswith("ä € 😀 <|endoftext|> [EMAIL]\n") and by_id(out)[1][0].text is None


def test_secrets_under_long_names_are_candidates(spark):
    texts = ["MY_APPLICATION_SECRET_ACCESS_KEY=abcd1234efgh5678", "api_key_2 = abcd1234efgh5678", "x" * 20_000 + "=abcd1234", "no secret: here"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(pii.candidates(pii.F.col("text")).alias("c"))
    assert [[pii.KINDS[c["rank"]] for c in r["c"]] for r in rows.collect()] == [["secret"], ["secret"], ["secret"], []]


def test_packing(docs, none):
    got = packing.pack(docs, *packing.vocabulary()).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    assert sum(r.length for r in got if r.doc_id == 1) == 1 and {r.ids_crc32 for r in got if r.doc_id == 1} == {zlib.crc32(bytes(4))}
    assert sum(r.doc_id == 8 for r in got) == 2 and packing.pack(none, *packing.vocabulary()).count() == 0


def test_packing_fills_sequences():
    steps = packing.plan({2048: 5, 1024: 101, 700: 90, 648: 90, 100: 777, 1: 40, 2000: 3})
    total = 5 * 2048 + 101 * 1024 + 90 * 1348 + 77_700 + 40 + 6000
    used = max(s + n for _, _, n, s, _ in steps)
    assert used <= -(-total // 2048) + 2 and sum(n for _, _, n, _, _ in steps) == 5 + 101 + 90 + 90 + 777 + 40 + 3


def test_toxicity(docs, labels, none):
    got = by_id(toxicity.toxicity(docs, labels))
    assert sum(map(len, got.values())) == len(ODD) and all(0 <= r.score <= 1 for rs in got.values() for r in rs)
    assert got[1][0].score == got[2][0].score and got[4][0].score == got[5][0].score
    assert got[5][0].held_out == (zlib.crc32(b"5") % 5 == 0) and not got[None][0].held_out
    assert toxicity.toxicity(none, labels).count() == 0
    assert all(r.score == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_pipeline_stages(spark, docs, labels, none, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs.select("doc_id", "text", "lang", "source", "n_chars"), none):
        kept = rows
        for name, stage in corpus_pipeline.STAGES:
            out = staged(stage(spark, kept, str(tmp_path)), name)
            if name != "best_fit_packing":
                assert out.columns == kept.columns and out.count() <= kept.count()
            kept = out
        assert set(kept.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
