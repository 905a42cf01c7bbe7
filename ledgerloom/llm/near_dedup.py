"""Near-duplicate documents by DartMinHash signatures.

A document is a weighted set of its shingles (SHINGLE words each); a shingle's weight is the number of its occurrences.
Every unit of a shingle's weight is a region into which a hash function throws darts over time, about one per unit of
time, each at one of the COORDINATES. A signature holds, per coordinate, the dart that comes earliest; two documents
agree there with the probability of their weighted Jaccard similarity (the sum of the lesser weights over that of the
greater). Time is thrown only as far as a document's total weight needs, so the work is about
COORDINATES * log(COORDINATES) darts for any document.

Signatures are banded. Equal texts are folded first. In each bucket every member is compared with a hub, never all with
all: the member that meets most others over all its buckets, which in a group of copies is the text that they were made
from or one near it. Buckets left with members of different classes get a new hub, HUB_ROUNDS times in all. Where that
still leaves different classes, members are compared across classes, in blocks of bounded size: first by sketches of their
shingles, and pairs no more than MARGIN standard deviations of the sketches' error below the wanted similarity exactly,
in the same task, so only links leave it. All links are verified by the exact weighted Jaccard similarity, and classes
are their connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import map_slices, staged, table, whole
from ledgerloom.llm.components import components
from ledgerloom.llm.words import Words

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 5: a pair of similarity 0.8 shares none with probability 0.0001.
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Members that are compared with a hub in one task.
HUB_SHARE = 256
#: Hubs that a bucket gets before its members are compared across classes.
HUB_ROUNDS = 3
#: Members of a block, and bytes of their shingles: two blocks of a bucket are compared in one task.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Bins of a sketch.
BINS = 512
#: Standard deviations of a sketch's error below the wanted similarity from which pairs are not verified.
MARGIN = 5
#: Candidates up to which their list is broadcast to the texts; beyond it the texts are shuffled.
BROADCAST_ROWS = 300_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A random-looking number for each number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a text, given its words' hashes: with repeats, in order. A short text is one shingle."""
    n = len(hashes) - SHINGLE + 1
    if not len(hashes):
        return hashes
    with np.errstate(over="ignore"):
        if n < 1:
            out = np.array([len(hashes)], U)
            for h in hashes:
                out = mix(out * U(0x9E3779B97F4A7C15) + h)
            return out
        out = np.zeros(n, U)
        for k in range(SHINGLE):
            out = mix(out * U(0x9E3779B97F4A7C15) + hashes[k : k + n])
        return out


#: Time is cut where all documents cut it: 1/16, 1/8, 1/4, 1/2, 1, then whole numbers. No cell is larger than 1.
FIRST_CUTS = [0.0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0]
#: More darts than this in one cell of area 1 come with probability 1e-11.
MOST_DARTS = 13


def throw(elements: np.ndarray, share: np.ndarray, start: float, end: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, coordinate, dart) of the darts in the elements' regions between two cuts. share: the part of the unit of
    weight that an element has."""
    cuts = np.array([c for c in FIRST_CUTS if start <= c <= end] + list(range(max(2, math.floor(start) + (start == 1)), math.floor(end) + 1)))
    cuts = np.unique(np.concatenate([[start], cuts, [end]]))
    lo, area = cuts[:-1], np.diff(cuts)
    with np.errstate(over="ignore"):
        cell = mix(elements[:, None] + mix((lo * 16).astype(np.uint64) * U(2) + U(1))[None, :])
        chance = (cell >> U(11)).astype(np.float64) / (1 << 53)
        term = np.exp(-area)
        below = term.copy()
        row, col = np.nonzero(chance > below[None, :])
        found = []
        hashes, chance = cell[row, col], chance[row, col]
        for j in range(MOST_DARTS):
            if not len(row):
                break
            found.append((col, mix(hashes + U(0xD1B54A32D192ED03) * U(j + 1)), row))
            term = term * area / (j + 1)
            below = below + term
            more = chance > below[col]
            row, col, hashes, chance = row[more], col[more], hashes[more], chance[more]
        if not found:
            return np.empty(0), np.empty(0, np.int64), np.empty(0, U)
        col, dart, row = (np.concatenate(x) for x in zip(*found))
        depth = (mix(dart + U(1)) >> U(11)).astype(np.float64) / (1 << 53)
        inside = depth < share[row]
        col, dart = col[inside], dart[inside]
        when = lo[col] + area[col] * ((dart & U((1 << 40) - 1)).astype(np.float64) / (1 << 40))
        return when, ((dart >> U(40)) % U(COORDINATES)).astype(np.int64), dart


def regions(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A region for each unit of the elements' weights, and the part of the unit that the weight fills."""
    units = np.ceil(weights).astype(np.int64)
    unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    with np.errstate(over="ignore"):
        names = mix(np.repeat(elements, units) + U(0xA24BAED4963EE407) * unit.astype(U))
    return names, np.minimum(1.0, np.repeat(weights, units) - unit)


def signature(elements: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The earliest dart at each coordinate, for distinct elements with weights (1 each by default). At least one element."""
    if weights is None:
        share = np.ones(len(elements))
    else:
        elements, share = regions(elements, weights)
    total = share.sum()
    need = COORDINATES * (math.log(COORDINATES) + 2) / total
    start, end = 0.0, 1 / 16
    while end < need:
        end *= 2
    out, open_ = np.zeros(COORDINATES, U), np.ones(COORDINATES, bool)
    while open_.any():
        when, where, dart = throw(elements, share, start, end)
        keep = open_[where]
        when, where, dart = when[keep], where[keep], dart[keep]
        order = np.argsort(when)[::-1]
        out[where[order]] = dart[order]
        open_[where] = False
        start, end = end, 2 * end
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band."""
    rows = signature.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=U)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """One byte of the least 32-bit hash (sorted, distinct) in each of BINS parts of the hash range, 0 where there is none.

    Of a text with fewer shingles than bins that is most of them, so the error of a similarity is far below a signature's.
    """
    out = np.zeros(BINS, np.uint8)
    bins, first = np.unique(found >> np.uint32(32 - BINS.bit_length() + 1), return_index=True)
    out[bins] = mix(found[first].astype(U)) % U(255) + U(1)
    return out


def alike_enough(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same >= least * (len(a) + len(b) - same) - 1e-9


def weighed(hashes: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct shingles of a text, given its words' hashes, and their weights: "count" occurrences, "set" 1 each (None)."""
    found, counts = np.unique(shingles(hashes), return_counts=True)
    return found, counts.astype(float) if weights == "count" else None


def filled(found: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    """The regions of distinct shingles with whole weights, sorted: sets of them have the weighted similarity."""
    return found if weights is None else np.sort(regions(found, weights)[0])


def signed_task(batches: Iterator[pd.DataFrame], weights: str) -> Iterator[pd.DataFrame]:
    words = Words()
    for batch in batches:
        prints, keys = [], []
        for text in batch["text"]:
            hashes = words.of(text or "")[1]
            print_ = xxhash.xxh3_128(hashes.tobytes()).digest()
            found, weight = weighed(hashes, weights)
            prints.append(print_)
            keys.append(band_keys(signature(found, weight)) if len(found) else np.empty(0, np.int64))
        yield batch[["id", "number", "doc_id"]].astype({"doc_id": "Int64"}).assign(print=prints, keys=keys)


def shingled_task(batches: Iterator[pd.DataFrame], weights: str) -> Iterator[pd.DataFrame]:
    """Sorted distinct 32-bit hashes of the regions of each text's shingles."""
    words = Words()
    for batch in batches:
        sets = [np.unique((filled(*weighed(words.of(t or "")[1], weights)) >> U(32)).astype(np.uint32)).tobytes() for t in batch["text"]]
        yield batch.drop(columns="text").assign(shingles=sets)


def verify_task(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Rows come sorted by hub and share, the hub's own row first. Yields the links that hold."""
    at, hub_set = None, None
    for batch in batches:
        a, b = [], []
        for hub, share, id_, data in zip(batch["hub"], batch["share"], batch["id"], batch["shingles"]):
            own = np.frombuffer(data, np.uint32)
            if id_ == hub:
                at, hub_set = (hub, share), own
            elif at == (hub, share):
                if alike_enough(own, hub_set, least):
                    a.append(id_)
                    b.append(hub)
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def verified(pairs: DataFrame, texts: DataFrame, least: float, weights: str) -> DataFrame:
    """The pairs (id, hub) whose texts have at least that similarity, as links (a, b).

    Each text moves to its hubs once a hub; a hub with many partners is copied to several shares of them, so that no task
    gets more than HUB_SHARE partners of one hub.
    """
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_SHARE).cast("int").alias("shares"))
    wanted = pairs.join(counts, "hub").groupBy("id").agg(F.collect_list(F.struct("hub", F.pmod(F.xxhash64("id"), "shares").cast("int").alias("share"))).alias("hubs"))
    wanted = staged(wanted.join(counts.withColumnRenamed("hub", "id"), "id", "full").select("id", "hubs", "shares"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    moved = map_slices(texts.join(wanted, "id").select("id", "text", "hubs", "shares"), lambda x: shingled_task(x, weights), "id long, hubs array<struct<hub:long,share:int>>, shares int, shingles binary")
    own = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda s: F.struct(F.col("id").alias("hub"), s.alias("share")))
    none = F.array().cast("array<struct<hub:long,share:int>>")
    dealt = moved.select("id", "shingles", F.explode(F.concat(F.coalesce(own, none), F.coalesce("hubs", none))).alias("to"))
    dealt = dealt.select(F.col("to.hub").alias("hub"), F.col("to.share").alias("share"), "id", "shingles")
    sorted_ = dealt.repartition("hub", "share").sortWithinPartitions("hub", "share", F.col("id") != F.col("hub"))
    return sorted_.mapInPandas(lambda x: verify_task(x, least), "a long, b long")


def row_id(doc_id: str = "doc_id", text: str = "text"):
    """The document's number; where it is null a hash of the text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(whole(text)))


def identity():
    """A hash of doc_id and text: rows with one doc_id and different texts are different documents."""
    no_id, no_text = F.col("doc_id").isNull(), F.col("text").isNull()
    return F.xxhash64(no_id, F.col("doc_id").cast("long"), no_text, F.col("text"))


def near_dedup(documents: DataFrame, least: float = SIMILARITY, weights: str = "count") -> DataFrame:
    """doc_id, class_id, class_size and kept of every row of documents (doc_id, text), as classes() tells them."""
    return classes(documents, least, weights).drop("id")


def keep_one(documents: DataFrame, least: float = SIMILARITY, weights: str = "count") -> DataFrame:
    """The rows of documents that stay, one of each class, with all their columns."""
    found = classes(documents.select("doc_id", "text"), least, weights).filter("kept").select(F.col("id").alias("__id"))
    rows = documents.withColumn("__id", identity())
    return rows.join(found, "__id", "left_semi").dropDuplicates(["__id"]).drop("__id")


def classes(documents: DataFrame, least: float = SIMILARITY, weights: str = "count") -> DataFrame:
    """id, doc_id, class_id, class_size and kept of every row of documents (doc_id, text).

    A class is a connected component of documents whose shingles have a weighted Jaccard similarity of `least` or more; its
    id is its least doc_id, and kept is true for that row. Rows that share a doc_id but not the text are documents of their
    own, told apart by their identity(), which is the id of a row: of several texts with the least doc_id that with the
    least identity is kept, and of several classes with the same least doc_id only that whose kept row has the least
    identity is named by it, the others by the identities of their kept rows. Words are runs without ASCII white space. Texts with the same
    words are one from the start (null and empty texts too: they are a class of their own). Texts of fewer than SHINGLE
    words are one shingle. Rows that repeat a doc_id and text share their verdict. A null doc_id takes part under a hash
    of its text. weights "count" gives shingles their numbers of occurrences as weights in the signatures; "set" gives 1.
    Other columns are ignored; no documents, no rows.
    """
    docs = documents.select(identity().alias("id"), row_id().alias("number"), F.col("doc_id").cast("long"), "text")
    signed = staged(map_slices(docs, lambda x: signed_task(x, weights), "id long, number long, doc_id long, print binary, keys array<long>"), "signed")
    alike = staged(signed.groupBy("print").agg(F.min("id").alias("node"), F.min(F.struct("number", "id")).alias("first"), F.count("*").alias("copies")), "alike")
    nodes = signed.join(alike.select("print", F.col("node").alias("id")), ["print", "id"], "left_semi").dropDuplicates(["print", "id"])
    members = staged(in_buckets(nodes.select("id", F.explode("keys").alias("key")), "id").select("id", "key", "members"), "members")
    met = members.groupBy("id").agg(F.sum("members").alias("met"))
    members = staged(members.select("id", "key").join(met, "id"), "met")
    texts = docs.select("id", "text")

    apart, found = members.withColumn("class", F.col("id")), None
    for _ in range(HUB_ROUNDS):
        # The member that meets most others and was no hub before; members of its class need no comparison with it.
        best = F.max_by(F.struct(F.col("id").alias("hub"), F.col("class").alias("of")), F.struct("met", "id"))
        hubs = apart.groupBy("key").agg(best.alias("h")).select("key", "h.hub", "h.of")
        pairs = apart.join(hubs, "key").filter(F.col("class") != F.col("of")).select("id", "hub").distinct()
        found = joined(found, verified(pairs, texts, least, weights))
        left = apart.join(hubs, "key").filter(F.col("id") != F.col("hub")).select("id", "key", "met").join(found.withColumnRenamed("node", "id"), "id", "left")
        apart = staged(in_buckets(left.withColumn("class", F.coalesce("root", "id")), "class").select("id", "key", "met", "class"), "apart")
        if not apart.limit(1).count():
            break
    else:
        found = joined(found, across_classes(apart.select("id", "key", "class"), texts, least, weights))

    of_print = alike.join(found, "node", "left").select("print", "copies", "first", F.coalesce("root", "node").alias("root"))
    sizes = of_print.groupBy("root").agg(F.sum("copies").alias("class_size"), F.min("first").alias("first"))
    sizes = sizes.select("root", "class_size", F.col("first.number").alias("number"), F.col("first.id").alias("kept_id"))
    owners = sizes.groupBy("number").agg(F.min("kept_id").alias("owner"))
    named = sizes.join(owners, "number").select("root", "class_size", "kept_id", F.when(F.col("kept_id") == F.col("owner"), F.col("number")).otherwise(F.col("kept_id")).alias("class_id"))
    return signed.join(of_print.select("print", "root").join(named, "root"), "print").select(
        "id", "doc_id", "class_id", "class_size", (F.col("id") == F.col("kept_id")).alias("kept")
    )


def compare_task(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket and pair of blocks. Yields links between different classes, no more than join them."""
    held, at, out = [], None, []

    def compare():
        ids, classes_ = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
        sets = [np.frombuffer(h[2], np.uint32) for h in held]
        bins, sizes = np.stack([sketch(x) for x in sets]), np.array([len(x) for x in sets])
        root: dict[int, int] = {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        step = max(1, (1 << 14) // len(held))
        for lo in range(0, len(held), step):
            some = bins[lo : lo + step, None, :]
            union = np.count_nonzero(some | bins[None], axis=2)
            same = np.count_nonzero((some == bins[None]) & (some > 0), axis=2)
            # The union's bins are a sample of the union's shingles, without replacement.
            sampled = np.minimum(1, union * (1 + least) / (sizes[lo : lo + step, None] + sizes[None]))
            error = np.sqrt(least * (1 - least) / np.maximum(union, 1) * (1 - sampled)) + 0.003
            like = same >= (least - MARGIN * error) * union
            for a, b in zip(*np.nonzero(like & (ids[lo : lo + step, None] > ids[None, :]) & (classes_[lo : lo + step, None] != classes_[None, :]))):
                x, y = find(classes_[lo + a]), find(classes_[b])
                if x != y and alike_enough(sets[lo + a], sets[b], least):
                    root[x] = y
                    out.append((ids[lo + a], ids[b]))

    for batch in batches:
        for key, low, high, id_, class_, data in zip(*(batch[c] for c in ("key", "low", "high", "id", "class", "shingles"))):
            if at != (key, low, high):
                if len(held) > 1:
                    compare()
                held, at = [], (key, low, high)
            held.append((id_, class_, data))
        if len(out) > 1000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    if len(held) > 1:
        compare()
    if out:
        yield pd.DataFrame(out, columns=["a", "b"])


def across_classes(members: DataFrame, texts: DataFrame, least: float, weights: str) -> DataFrame:
    """Links (a, b) between members (id, key, class) that share a bucket and are of different classes.

    A bucket's members are dealt to blocks; each pair of blocks is one group of 2 * BLOCK members or 2 * BLOCK_BYTES of
    shingles or so, however large the bucket is.
    """
    wanted = staged(members.select("id").distinct(), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = staged(map_slices(texts.join(wanted, "id").select("id", "text"), lambda x: shingled_task(x, weights), "id long, shingles binary"), "sets")
    sized = members.join(sets.select("id", F.length("shingles").alias("bytes")).dropDuplicates(["id"]), "id")
    blocks = sized.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").join(sets.dropDuplicates(["id"]), "id").withColumn("own", F.pmod(F.xxhash64("id", "key"), "blocks").cast("int"))
    dealt = dealt.select("key", "id", "class", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "class", "shingles")
    grouped = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return map_slices(grouped, lambda x: compare_task(x, least), "a long, b long")


def in_buckets(members: DataFrame, by: str) -> DataFrame:
    """The members of buckets in which `by` has more than one value, with the number of members."""
    ends = members.groupBy("key").agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count("*").alias("members")).filter("lo < hi")
    return members.join(ends.select("key", "members"), "key")


def joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, root) with further links."""
    links = staged(links, "verified")
    return components(links if found is None else links.union(found.select("node", "root")))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
