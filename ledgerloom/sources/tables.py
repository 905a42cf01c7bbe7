"""Reading tables and files with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LEDGER_ENTRY = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("assertion_id", T.StringType()), T.StructField("event", T.StringType()),
    T.StructField("recorded_at", T.TimestampType()), T.StructField("payload", T.StringType()), T.StructField("prev_hash", T.StringType()),
    T.StructField("entry_hash", T.StringType()),
])
#: File endings and MIME types that choose an adapter.
ADAPTERS = {"txt": "plain_text", "md": "markdown", "csv": "table", "tsv": "table", "pdf": "pdf", "vtt": "captions", "json": "transcript", "png": "image", "jpg": "image", "mp3": "audio", "mp4": "video"}
MIME = {"text/plain": "plain_text", "text/markdown": "markdown", "text/csv": "table", "application/pdf": "pdf", "text/vtt": "captions"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose_adapter(files: DataFrame) -> DataFrame:
    """files (name, kind, mime) with adapter: by kind, else by MIME type, else by ending, else unsupported."""
    lookup = lambda of, key: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[key]
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return files.withColumn("adapter", F.coalesce("kind", lookup(MIME, F.col("mime")), lookup(ADAPTERS, ending), F.lit("unsupported_source_kind")))


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """asset (path) and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("asset"), F.col("value").alias("text"))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """asset, line_no and line of text files, whole files read once so that lines keep their numbers."""
    return scan_text(spark, path).select("asset", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def scan_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Rows of delimited files; ragged rows keep what fits and carry the raw line."""
    return spark.read.schema(schema + ", _corrupt string").csv(path, sep=sep, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def scan_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON-lines ledgers; blank lines are skipped."""
    return spark.read.schema(LEDGER_ENTRY).json(path)


def scan_media(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """path, length and content hash of files under a folder, without those whose hash is known."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.filter(~F.col("path").rlike(r"/[.~][^/]*$|\.(tmp|part)$")).select("path", "length", F.sha2("content", 256).alias("content_hash"))
    return found.join(known.select("content_hash"), "content_hash", "left_anti") if known is not None else found


def captions(lines: DataFrame) -> DataFrame:
    """asset, line_no and text of caption lines: cue times, headers and markup go, repeats in a row are one."""
    from pyspark.sql import Window

    text = F.trim(F.regexp_replace("line", "<[^>]*>", ""))
    kept = lines.withColumn("text", text).filter((F.col("text") != "") & ~F.col("text").rlike(r"^(WEBVTT|NOTE|Kind:|Language:)|-->|^[0-9]+$"))
    before = F.lag("text").over(Window.partitionBy("asset").orderBy("line_no"))
    return kept.withColumn("before", before).filter("before IS NULL OR before <> text").select("asset", "line_no", "text")
