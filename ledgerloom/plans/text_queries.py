"""Queries on texts: ingest, quality, chunks, glossary, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.functions import scores, text as T
from ledgerloom.operators import ingest, resolve
from ledgerloom.sources.tables import choose_adapter, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Spark's fold() in DuckDB.
FOLD = "trim(regexp_replace(strip_accents(lower({c})), '[^0-9a-z]+', ' ', 'g'))"


def fold(c: str) -> str:
    return FOLD.format(c=c)


def toks(c: str) -> str:
    return f"list_filter(string_split({fold(c)}, ' '), lambda t: t <> '')"


@query("doc_quality_by_lang", rf"""
WITH s AS (SELECT lang, coalesce(text, '') AS t, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.\n]'), lambda x: {fold('x')}), lambda x: x <> '') AS s FROM documents),
f AS (SELECT lang, CASE WHEN trim(regexp_replace(t, '[\t\n\r\f\v]', ' ', 'g')) = '' THEN ['empty_text'] ELSE list_filter([
  CASE WHEN len(list_filter(range(1, len(s) - 1), lambda i: s[i] = s[i + 1] AND s[i] = s[i + 2])) > 0 THEN 'repeated_content' END,
  CASE WHEN length(trim(t)) < 24 THEN 'short_text' END], lambda x: x IS NOT NULL) END AS flags FROM s),
g AS (SELECT lang, flags, round(greatest(0, 1 - CASE WHEN list_contains(flags, 'short_text') THEN 0.10 ELSE 0 END
  - CASE WHEN list_contains(flags, 'repeated_content') THEN 0.25 ELSE 0 END - CASE WHEN list_contains(flags, 'empty_text') THEN 1.0 ELSE 0 END), 6) AS score FROM f)
SELECT lang, count(*) AS n_docs, count(*) FILTER (list_contains(flags, 'short_text')) AS n_short,
  count(*) FILTER (list_contains(flags, 'repeated_content')) AS n_repeated, round(CAST(avg(score) AS DOUBLE), 6) AS mean_score FROM g GROUP BY lang""")
def doc_quality_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    # A generated column is made once a row; a projected one would be pasted into every aggregate.
    rows = table(spark, sf, "documents").select("lang", F.explode(F.array(T.quality_flags(F.col("text")))).alias("flags"))
    has = lambda flag: F.count_if(F.array_contains("flags", flag))
    return rows.groupBy("lang").agg(
        F.count("*").alias("n_docs"), has("short_text").alias("n_short"), has("repeated_content").alias("n_repeated"),
        F.round(F.avg(T.quality_score(F.col("flags"))), 6).alias("mean_score"),
    )


@query("doc_paragraphs", r"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
o AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM p)
SELECT doc_id, i - 1 AS seq, CAST(coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start_at, length(l[i]) AS n_chars, sha256(l[i]) AS text_hash
FROM o WHERE trim(l[i]) <> ''""")
def doc_paragraphs(spark, sf):
    return ingest.paragraphs(table(spark, sf, "documents")).select(
        "doc_id", F.col("seq").cast("long"), F.col("start_at").cast("long"), F.length("paragraph").cast("long").alias("n_chars"), F.sha2("paragraph", 256).alias("text_hash")
    )


@query("doc_sentences", r"""
WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, CAST(max(length(s)) AS BIGINT) AS longest FROM s GROUP BY doc_id""")
def doc_sentences(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("s")).cast("long").alias("longest"))


@query("doc_exact_duplicates", "SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def doc_exact_duplicates(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query("doc_redaction_counts", r"""
WITH m AS (SELECT source, regexp_replace(regexp_replace(regexp_replace(text, '(token|password) ?= ?"?[A-Za-z0-9]{8,}"?', '<secret>', 'g'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+', '<email>', 'g'), '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '<ip>', 'g') AS t FROM documents)
SELECT source, CAST(sum(len(regexp_extract_all(t, '<secret>'))) AS BIGINT) AS secrets, CAST(sum(len(regexp_extract_all(t, '<email>'))) AS BIGINT) AS emails,
  CAST(sum(len(regexp_extract_all(t, '<ip>'))) AS BIGINT) AS ips FROM m GROUP BY source""")
def doc_redaction_counts(spark, sf):
    rows = table(spark, sf, "documents").select("source", T.redacted(F.col("text")).alias("t"))
    n = lambda mask: F.sum(F.regexp_count("t", F.lit(mask))).cast("long")
    return rows.groupBy("source").agg(n("<secret>").alias("secrets"), n("<email>").alias("emails"), n("<ip>").alias("ips"))


@query("doc_stable_ids", "SELECT doc_id, 'doc-' || left(sha256(concat_ws('|', source, lang, sha256(text))), 32) AS stable_id FROM documents")
def doc_stable_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.stable_id("doc", F.col("source"), F.col("lang"), F.sha2("text", 256)).alias("stable_id"))


@query("doc_fixed_windows", """
SELECT doc_id, CAST(w * 400 AS BIGINT) AS start_at, CAST(length(substring(text, w * 400 + 1, 500)) AS BIGINT) AS n_chars
FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 400.0) AS BIGINT)))) AS w FROM documents)""")
def doc_fixed_windows(spark, sf):
    return ingest.windows(table(spark, sf, "documents"), 500, 100).select("doc_id", F.col("start_at").cast("long"), F.length("window").cast("long").alias("n_chars"))


@query("doc_char_chunks")
def doc_char_chunks(spark, sf):
    return ingest.char_chunks(table(spark, sf, "documents"), 1000).select("doc_id", "seq", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_hash"))


@query("doc_token_stats", f"""
WITH t AS (SELECT lang, {toks('text')} AS t FROM documents)
SELECT lang, CAST(sum(len(t)) AS BIGINT) AS n_tokens, CAST(sum(len(list_distinct(t))) AS BIGINT) AS n_distinct, CAST(max(len(t)) AS BIGINT) AS longest FROM t GROUP BY lang""")
def doc_token_stats(spark, sf):
    rows = table(spark, sf, "documents").select("lang", T.tokens(F.col("text")).alias("t"))
    return rows.groupBy("lang").agg(F.sum(F.size("t")).cast("long").alias("n_tokens"), F.sum(F.size(F.array_distinct("t"))).cast("long").alias("n_distinct"), F.max(F.size("t")).cast("long").alias("longest"))


@query("glossary_terms", f"""
WITH w AS (SELECT lang, unnest({toks('text')}) AS term, doc_id FROM documents),
f AS (SELECT lang, term, count(*) AS frequency, count(DISTINCT doc_id) AS n_docs FROM w WHERE length(term) >= 5 GROUP BY lang, term HAVING count(*) >= 5)
SELECT lang, term, frequency, n_docs, round(least(1.0, 0.4 * least(1.0, n_docs / 20.0) + 0.3 * ln(1 + frequency) / ln(1001) + 0.3 * CASE WHEN length(term) >= 8 THEN 0.5 ELSE 0.2 END), 4) AS priority FROM f""")
def glossary_terms(spark, sf):
    words = table(spark, sf, "documents").select("lang", "doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).filter(F.length("term") >= 5)
    per_doc = words.groupBy("lang", "term", "doc_id").agg(F.count("*").alias("n"))
    found = per_doc.groupBy("lang", "term").agg(F.sum("n").alias("frequency"), F.count("*").alias("n_docs")).filter("frequency >= 5")
    boost = F.when(F.length("term") >= 8, 0.5).otherwise(0.2)
    return found.withColumn("priority", scores.term_priority(F.least(F.lit(1.0), F.col("n_docs") / 20.0), F.col("frequency"), boost))


@query("glossary_top_terms", f"""
WITH w AS (SELECT lang, unnest({toks('text')}) AS term FROM documents), f AS (SELECT lang, term, count(*) AS frequency FROM w WHERE length(term) >= 4 GROUP BY ALL)
SELECT lang, term, frequency, CAST(rk AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY frequency DESC, term) AS rk FROM f) WHERE rk <= 10""")
def glossary_top_terms(spark, sf):
    words = table(spark, sf, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("term")).filter(F.length("term") >= 4)
    order = Window.partitionBy("lang").orderBy(F.desc("frequency"), "term")
    return words.groupBy("lang", "term").agg(F.count("*").alias("frequency")).withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 10")


@query("benchmark_quotes", """
SELECT b.item_id, count(*) AS n_docs, min(d.doc_id) AS first_doc, CAST(min(instr(d.text, b.text)) AS BIGINT) AS least_place
FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id""")
def benchmark_quotes(spark, sf):
    return ingest.anchored_quotes(table(spark, sf, "documents"), table(spark, sf, "benchmark")).groupBy(F.col("quote_id").alias("item_id")).agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.min("place").cast("long").alias("least_place")
    )


@query("doc_category", """
WITH k(category, priority, keyword) AS (VALUES ('licence', 1, 'licensed'), ('licence', 1, 'license'), ('licence', 1, 'rights reserved'), ('secret', 2, 'token ='), ('secret', 2, 'password='),
  ('shouting', 3, '!!'), ('table', 4, ' | '), ('symbols', 5, '###'), ('symbols', 5, '$$$')),
h AS (SELECT d.doc_id, k.category, k.priority, count(*) AS hits FROM documents d JOIN k ON contains(lower(d.text), k.keyword) GROUP BY ALL)
SELECT d.doc_id, coalesce(b.category, 'prose') AS category, CAST(coalesce(b.hits, 0) AS BIGINT) AS hits FROM documents d
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, priority) AS rk FROM h) WHERE rk = 1) b USING (doc_id)""")
def doc_category(spark, sf):
    return ingest.classified(table(spark, sf, "documents"), ingest.CATEGORY_WORDS)


@query("conversation_windows")
def conversation_windows(spark, sf):
    return ingest.turn_windows(table(spark, sf, "conversations"), 1200)


@query("conversation_neighbours", """
SELECT conv_id, turn, lag(turn) OVER w AS previous_turn, lead(turn) OVER w AS next_turn, CAST(row_number() OVER w AS BIGINT) AS position,
  CAST(count(*) OVER (PARTITION BY conv_id) AS BIGINT) AS n_turns FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_neighbours(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.lag("turn").over(w).alias("previous_turn"), F.lead("turn").over(w).alias("next_turn"),
        F.row_number().over(w).cast("long").alias("position"), F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"),
    )


@query("page_sites", r"""
SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS site, count(*) AS n_pages, count(DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1)) AS n_langs,
  count(*) FILTER (url LIKE 'https:%') AS n_secure FROM pages GROUP BY 1""")
def page_sites(spark, sf):
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf, "pages").groupBy(part("^[a-z]+://([^/]+)").alias("site")).agg(
        F.count("*").alias("n_pages"), F.countDistinct(part("^[a-z]+://[^/]+/([a-z]+)/")).alias("n_langs"), F.count_if(F.col("url").startswith("https:")).alias("n_secure")
    )


@query("page_titles", r"""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs FROM pages""")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"))


@query("adapter_choice", r"""
WITH f AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS name, CASE WHEN page_id % 3 = 0 THEN 'text/csv' END AS mime, CASE WHEN page_id % 7 = 0 THEN 'markdown' END AS kind FROM pages)
SELECT page_id, coalesce(kind, CASE mime WHEN 'text/csv' THEN 'table' END, CASE lower(regexp_extract(name, '\.([^.]+)$', 1)) WHEN 'txt' THEN 'plain_text' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'transcript' END, 'unsupported_source_kind') AS adapter FROM f""")
def adapter_choice(spark, sf):
    files = table(spark, sf, "pages").select(
        "page_id", F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)).alias("name"),
        F.when(F.col("page_id") % 3 == 0, "text/csv").alias("mime"), F.when(F.col("page_id") % 7 == 0, "markdown").alias("kind"),
    )
    return choose_adapter(files).select("page_id", "adapter")


@query("table_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_rows, CAST(max(len(string_split(line, ' | '))) AS BIGINT) AS widest, CAST(min(len(string_split(line, ' | '))) AS BIGINT) AS narrowest FROM l WHERE contains(line, ' | ') GROUP BY doc_id""")
def table_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.contains("line", F.lit(" | ")))
    cells = F.size(F.split("line", r" \| "))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.max(cells).cast("long").alias("widest"), F.min(cells).cast("long").alias("narrowest"))


@query("document_temporal_words", r"""
SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\b(?:1[0-9]{3}|20[0-9]{2})\b'))) AS years FROM documents WHERE regexp_matches(text, '\b(?:1[0-9]{3}|20[0-9]{2})\b')""")
def document_temporal_words(spark, sf):
    years = F.regexp_extract_all("text", F.lit(r"\b(?:1[0-9]{3}|20[0-9]{2})\b"), F.lit(0))
    return table(spark, sf, "documents").filter(F.col("text").rlike(r"\b(?:1[0-9]{3}|20[0-9]{2})\b")).select("doc_id", F.array_sort(F.array_distinct(years)).alias("years"))


@query("embedding_label_centroids", """
WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT label, CAST(i AS BIGINT) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM x GROUP BY label, i""")
def embedding_label_centroids(spark, sf):
    x = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return x.groupBy("label", (F.col("i") + 1).cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("embedding_cosine_topk", """
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS score
  FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
SELECT query_id, vec_id, score, CAST(rk AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s) WHERE rk <= 5""")
def embedding_cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    return resolve.nearest(rows.filter("vec_id % 20 = 0"), rows, 5)
