"""From texts to addressable pieces: paragraphs, windows, chunks, turns, categories, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import text as T


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, seq, start_at (code points before it) and paragraph of each line that is not blank."""
    lines = F.split("text", "\n")
    starts = F.aggregate(
        lines, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"],
    )
    rows = documents.select("doc_id", F.posexplode(F.arrays_zip(lines.alias("paragraph"), starts.alias("start_at"))).alias("seq", "p"))
    return rows.select("doc_id", "seq", "p.start_at", "p.paragraph").filter(F.trim("paragraph") != "")


def windows(documents: DataFrame, length: int, overlap: int) -> DataFrame:
    """Windows of fixed length that overlap; an empty text has one empty window."""
    step = max(1, length - overlap)
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / step).cast("int"))
    rows = documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return rows.select("doc_id", (F.col("k") * step).alias("start_at"), F.substring("text", F.col("k") * step + 1, F.lit(length)).alias("window"))


def char_chunks(documents: DataFrame, most: int) -> DataFrame:
    """Chunks of at most so many characters, cut after the last white space that fits or, without one, at the limit."""
    pattern = rf"(?s).{{1,{most}}}\z|.{{1,{most}}}(?<=\s)|.{{1,{most}}}"
    return documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("seq", "chunk"))


def turn_windows(turns: DataFrame, most: int) -> DataFrame:
    """Windows of consecutive turns of one role of at most so many characters: a new one starts when the role changes or
    the text would be too long, so where it starts depends on where the one before did; an ordered fold."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.length(F.coalesce("text", F.lit(""))).alias("n")))).alias("turns"))
    empty = F.struct(F.lit(0).alias("window"), F.lit("").alias("role"), F.lit(0).alias("n"), F.array().cast("array<struct<turn:bigint,window:int,n:int>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        new = (t["role"] != s["role"]) | (s["n"] + t["n"] > most)
        window = s["window"] + F.when(new, 1).otherwise(0)
        return F.struct(
            window.alias("window"), t["role"].alias("role"), F.when(new, t["n"]).otherwise(s["n"] + t["n"]).alias("n"),
            F.concat(s["out"], F.array(F.struct(t["turn"].cast("bigint").alias("turn"), window.alias("window"), t["n"].alias("n")))).alias("out"),
        )

    folded = rows.select("conv_id", F.explode(F.aggregate("turns", empty, step, lambda s: s["out"])).alias("t"))
    return folded.groupBy("conv_id", F.col("t.window").alias("window")).agg(F.min("t.turn").alias("first_turn"), F.max("t.turn").alias("last_turn"), F.sum("t.n").alias("n_chars"))


# Words that speak for a category, and its priority among equals: rule data.
CATEGORY_WORDS = [
    ("licence", 1, "licensed"), ("licence", 1, "license"), ("licence", 1, "rights reserved"), ("secret", 2, "token ="), ("secret", 2, "password="),
    ("shouting", 3, "!!"), ("table", 4, " | "), ("symbols", 5, "###"), ("symbols", 5, "$$$"),
]


def classified(documents: DataFrame, words: list[tuple[str, int, str]], default: str = "prose") -> DataFrame:
    """doc_id, category and hits: the category with most of its words in the text, the lesser priority among equals.

    One pass without a join: the rules are a few, so the hits of each category are one expression.
    """
    lower, order = F.lower("text"), {}
    for category, priority, word in words:
        order.setdefault((priority, category), []).append(F.contains(lower, F.lit(word)).cast("int"))
    options = F.array(*[F.struct((-sum(hits)).alias("least"), F.lit(priority).alias("priority"), F.lit(category).alias("category")) for (priority, category), hits in order.items()])
    best = F.array_min(options)
    rows = documents.select("doc_id", best.alias("best"))
    return rows.select("doc_id", F.when(F.col("best.least") < 0, F.col("best.category")).otherwise(default).alias("category"), (-F.col("best.least")).cast("long").alias("hits"))


#: Quotes up to which their keys go to all tasks; the keys of more are shuffled to the documents'.
QUOTES_SENT = 200_000


def anchored_quotes(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, quote_id and place (from 1) of quotes (item_id, text) that stand literally in a document; empty ones in none.

    Both sides are keyed, so only documents that may have a quote are searched for it. A quote may start and end within a
    document's word, so its key is its second to fourth word if it has five or more, its second word if it has three or
    four, and else its first characters, three at most; a document has all of its own words, threes of words, and runs of
    characters, of which the last are looked at only if there are such quotes.
    """
    words = F.split("text", r"\s+")
    n = F.size(words)
    grams = F.least(F.length("text"), F.lit(3))
    sort = F.when(n >= 5, "words").when(n >= 3, "word").otherwise(F.concat(F.lit("gram"), grams.cast("string")))
    key = F.when(n >= 5, F.xxhash64(F.slice(words, 2, 3))).when(n >= 3, F.xxhash64(F.get(words, F.lit(1)))).otherwise(F.xxhash64(F.substring("text", F.lit(1), grams)))
    keyed = quotes.filter(F.length("text") > 0).select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"), sort.alias("sort"), key.alias("key"))
    sorts = [r["sort"] for r in keyed.select("sort").distinct().collect()]  # five at most
    rest = lambda a, k: F.slice(a, F.lit(k), F.greatest(F.size(a) - k + 1, F.lit(0)))
    chars = F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))
    keys = {
        "words": F.transform(F.arrays_zip(words.alias("a"), rest(words, 2).alias("b"), rest(words, 3).alias("c")), lambda t: F.xxhash64(F.array(t["a"], t["b"], t["c"]))),
        "word": F.transform(words, lambda w: F.xxhash64(w)),
        "gram1": F.transform(chars, lambda c: F.xxhash64(c)),
        "gram2": F.transform(F.arrays_zip(chars.alias("a"), rest(chars, 2).alias("b")), lambda t: F.xxhash64(F.concat(t["a"], t["b"]))),
        "gram3": F.transform(F.arrays_zip(chars.alias("a"), rest(chars, 2).alias("b"), rest(chars, 3).alias("c")), lambda t: F.xxhash64(F.concat(t["a"], t["b"], t["c"]))),
    }
    small = keyed.limit(QUOTES_SENT + 1).count() <= QUOTES_SENT
    found = None
    for s in sorts:
        docs = documents.filter("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(keys[s])).alias("key"))
        wanted = keyed.filter(F.col("sort") == s).select("quote_id", "key")
        part = docs.join(F.broadcast(wanted) if small else wanted, "key").select("doc_id", "quote_id")
        found = part if found is None else found.union(part)
    if found is None:
        return documents.select("doc_id", F.lit(None).cast(quotes.schema["item_id"].dataType).alias("quote_id"), F.lit(0).alias("place")).limit(0)
    both = found.distinct().join(documents.select("doc_id", "text"), "doc_id").join(keyed.select("quote_id", "quote"), "quote_id")
    return both.withColumn("place", F.instr("text", F.col("quote"))).filter("place > 0").select("doc_id", "quote_id", "place")
