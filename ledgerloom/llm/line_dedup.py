"""Line dedup by a deletion-neighbourhood join (native).

Lines (split at line feeds; blank ones always stay) are compared by word edits: words are what spaces separate, and two
lines of MIN_WORDS words or more are the same if one insertion, deletion or substitution of a word turns one into the
other. Shorter lines are the same only if equal. A line goes if an earlier line, by doc_id and place, is the same.

Equal lines are folded by 128-bit hashes, which move instead of the texts. A line's neighbourhood is the set of its
variants with one word deleted, as hashed keys: lines that differ by a substitution share the variant without that word
at that place, and a line with a word too many has the other line among its variants. A variant's key is the sum of
hashes of its neighbouring words, so it follows from the line's sum in constant time. One edit leaves the first or the
last half of a line as it is, so variants are emitted only for lines that share a half with another line, and only for
places in the other half. In a bucket of equal variants each line is joined with the earliest only, which loses nothing:
all of them are one substitution apart. The texts of the joined pairs verify the edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import staged, table, whole

#: Lines with fewer words are the same only if equal.
MIN_WORDS = 8
#: Rows (of some 200 bytes) up to which the list of lines to look at again is broadcast; beyond it the texts are shuffled.
BROADCAST_ROWS = 250_000


def line_hash(line: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), line).alias("h1"), F.xxhash64(F.lit(2), line).alias("h2")]


def n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def half_keys(line: Column, n: Column) -> Column:
    """Keys of the halves that the line shares with lines one word edit away: even ones of first halves, odd ones of last
    halves. A half has half the words of the shorter line, rounded so that an edit cannot touch both."""
    keys = []
    for m in (F.floor((n - 1) / 2).cast("int"), F.floor((n - 2) / 2).cast("int")):
        keys.append(F.shiftleft(F.xxhash64(F.lit(1), m, F.call_function("substring_index", line, F.lit(" "), m)), 1))
        keys.append(F.shiftleft(F.xxhash64(F.lit(2), m, F.call_function("substring_index", line, F.lit(" "), -m)), 1).bitwiseOR(F.lit(1)))
    return F.when(n >= MIN_WORDS, F.array_distinct(F.array(*keys))).otherwise(F.array().cast("array<bigint>"))


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, rid (a hash of the text), line_no and line of every line."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("rid"), whole("text").alias("text"))
    return rows.select("doc_id", "rid", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def low(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def high(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32)


def variants(found: DataFrame) -> DataFrame:
    """h1, h2, first, at (the place deleted), near (key without the place) and same (key with it) of the variants of lines
    (h1, h2, first, line, by_first, by_last), and own: the line's own key."""
    w = F.split("line", " ")
    rows = found.withColumn("w", w).withColumn("n", F.size("w"))
    rows = rows.withColumn("before", F.concat(F.array(F.lit("")), F.slice("w", F.lit(1), F.col("n") - 1)))
    rows = rows.withColumn("after", F.concat(F.slice("w", F.lit(2), F.col("n") - 1), F.array(F.lit(""))))
    pairs = F.zip_with("before", "w", lambda a, b: F.xxhash64(a, b))
    total = lambda part: F.aggregate("pairs", F.lit(0).cast("long"), lambda s, h: s + part(h)) + part(F.xxhash64(F.element_at("w", -1), F.lit("")))
    rows = rows.withColumn("pairs", pairs).select("h1", "h2", "first", "by_first", "by_last", "n", "w", "before", "after", total(low).alias("a"), total(high).alias("b"))
    change = lambda t, part: part(F.xxhash64(t["before"], t["after"])) - part(F.xxhash64(t["before"], t["w"])) - part(F.xxhash64(t["w"], t["after"]))
    steps = F.transform(F.arrays_zip("before", "w", "after"), lambda t: F.struct(change(t, low).alias("a"), change(t, high).alias("b")))
    shorter = F.floor((F.col("n") - 2) / 2)
    return (
        rows.select("h1", "h2", "first", "by_first", "by_last", "n", "a", "b", F.posexplode(steps).alias("at", "d"))
        .filter((F.col("by_first") & (F.col("at") >= shorter)) | (F.col("by_last") & (F.col("at") < F.col("n") - shorter)))
        .select(
            "h1", "h2", "first", "at",
            F.xxhash64(F.col("a") + F.col("d.a"), F.col("b") + F.col("d.b"), F.col("n") - 1).alias("near"),
            F.xxhash64("a", "b", "n").alias("own"),
        )
        .withColumn("same", F.xxhash64("near", "at"))
    )


def small(rows: DataFrame) -> DataFrame:
    """The rows, broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def one_edit(a: Column, b: Column) -> Column:
    """Whether at most one word edit lies between two lists of words."""
    equal = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
    longest = F.greatest(F.size(a), F.size(b))
    same = lambda place: F.when(place == 0, longest).otherwise(place - 1)
    return same(equal(a, b)) + same(equal(F.reverse(a), F.reverse(b))) >= longest - 1


def near_lines(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2 of distinct lines (h1, h2, first, keys) that are one word edit from an earlier one."""
    halves = distinct.select("h1", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi")
    looked = halves.join(shared.select("key"), "key", "left_semi").groupBy("h1").agg(
        F.bool_or(F.col("key") % 2 == 0).alias("by_first"), F.bool_or(F.col("key") % 2 != 0).alias("by_last")
    )
    looked = staged(distinct.drop("keys").join(looked, "h1").select("h1", "h2", "first", F.col("first.doc_id").alias("doc_id"), F.col("first.rid").alias("rid"), F.col("first.line_no").alias("line_no"), "by_first", "by_last"), "looked")
    wanted = small(looked)
    all_lines = lines(documents).alias("l")
    wanted = wanted.alias("w")
    found = all_lines.join(
        wanted, F.col("l.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("l.rid") == F.col("w.rid")) & (F.col("l.line_no") == F.col("w.line_no"))
    ).select("h1", "h2", "first", "by_first", "by_last", "line")
    found = staged(found.dropDuplicates(["h1", "h2"]), "texts")
    every = staged(variants(found), "variants")
    # Only keys that two lines have go on with their lines; their list is short, and broadcast if it is.
    twice = every.groupBy("same").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select("same")
    id_ = F.struct("first", "h1", "h2")
    twins = staged(every.join(small(staged(twice, "twice")), "same", "left_semi").select("same", id_.alias("id")), "twins")
    swaps = twins.join(twins.groupBy("same").agg(F.min("id").alias("hub")), "same").filter("id <> hub").select("hub", "id")
    own = staged(every.select("own", id_.alias("hub")).distinct(), "own")
    longer = every.join(small(own), every["near"] == own["own"]).select("hub", id_.alias("id"))
    ends = lambda c, end: (F.col(f"{c}.first").alias("first" + end), F.col(f"{c}.h1").alias("h1" + end), F.col(f"{c}.h2").alias("h2" + end))
    swaps, drops = (x.select(*ends("hub", ""), *ends("id", "_b")) for x in (swaps, longer))
    pairs = swaps.union(drops).distinct()
    words = found.select("h1", "h2", F.split("line", " ").alias("w"))
    both = pairs.join(words, ["h1", "h2"]).join(words.toDF("h1_b", "h2_b", "w_b"), ["h1_b", "h2_b"]).filter(one_edit(F.col("w"), F.col("w_b")))
    later = F.when(F.col("first") < F.col("first_b"), F.struct(F.col("h1_b").alias("h1"), F.col("h2_b").alias("h2"))).otherwise(F.struct("h1", "h2"))
    return both.select(later.alias("x")).select("x.h1", "x.h2").distinct()


def dropped_lines(documents: DataFrame) -> DataFrame:
    """doc_id, rid and keep (a boolean for each line of the text) of the documents that lose lines."""
    every = lines(documents)
    n = n_words(F.col("line"))
    blank = ~F.col("line").rlike(r"[^\x20\x09-\x0D]")
    seen = every.filter(~blank).select("doc_id", "rid", "line_no", *line_hash(F.col("line")), half_keys(F.col("line"), n).alias("keys"))
    seen = staged(seen, "lines")
    place = F.struct("doc_id", "rid", "line_no")
    distinct = staged(seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max_by("keys", "line_no").alias("keys")), "distinct")
    near = near_lines(documents, distinct).withColumn("near", F.lit(True))
    verdict = distinct.select("h1", "h2", "first").join(near, ["h1", "h2"], "left")
    judged = seen.select("doc_id", "rid", "line_no", "h1", "h2").join(verdict, ["h1", "h2"])
    gone = judged.filter(F.coalesce("near", F.lit(False)) | ~place.eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "rid").agg(F.collect_set("line_no").alias("gone"))


def line_dedup(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text and any other columns), text without the lines that repeat an earlier line, and n_dropped.

    Null texts stay null; texts whose lines all go become empty. Blank lines stay. Rows that repeat a doc_id and text
    count as one document; of rows that share only the doc_id the one with the lesser hash of its text is the earlier. A
    null doc_id comes first. Columns named n_dropped are replaced. No documents, no rows.
    """
    columns = [c for c in documents.columns if c != "n_dropped"]
    gone = dropped_lines(documents.select("doc_id", "text")).toDF("__doc_id", "__rid", "__gone")
    rows = documents.select(*columns).withColumn("__hash", F.xxhash64("text"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__hash") == F.col("__rid")), "left")
    # One flag a line, in order: runs of true up to each place that goes. So the work is linear in the text.
    every, gone = F.split("text", "\n"), F.array_sort("__gone")
    runs = F.zip_with(gone, F.concat(F.array(F.lit(-1)), gone), lambda to, after: to - after - 1)
    flags = F.concat(
        F.flatten(F.transform(F.slice(runs, F.lit(1), F.size(gone)), lambda n: F.concat(F.array_repeat(F.lit(True), n), F.array(F.lit(False))))),
        F.array_repeat(F.lit(True), F.size(every) - 1 - F.array_max(gone)),
    )
    zipped = F.filter(F.arrays_zip(every.alias("line"), flags.alias("stays")), lambda x: x["stays"])
    kept = F.transform(zipped, lambda x: x["line"])
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.withColumn("text", text).withColumn("n_dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).select(*columns, "n_dropped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines left, n_dropped and the hash of the text left."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = whole("text")
    return out.select("doc_id", F.size(F.split(text, "\n")).cast("long").alias("n_lines"), "n_dropped", F.sha2(text, 256).alias("text_sha256"))
