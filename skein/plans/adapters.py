"""Model relations over the driver's tables: what stands for books, chapters, narrations, events and claims. Each has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import chunks
from ..operators.store import numbered
from ..operators.tiers import draft


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    docs = numbered(table(spark, folder, "documents").select("doc_id", "source", "text"), "source", "doc_id")
    return docs.select(F.col("doc_id").alias("chapter_id"), F.col("source").alias("book_id"), "idx", F.concat(F.lit("doc "), "doc_id").alias("title"), "text")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """chapters() without their place in the book, which costs two shuffles."""
    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("chapter_id"), F.col("source").alias("book_id"), F.concat(F.lit("doc "), "doc_id").alias("title"), "text")


CHAPTERS = """chapters AS (SELECT doc_id AS chapter_id, source AS book_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS idx,
  'doc ' || doc_id AS title, text FROM documents)"""


def all_chunks(spark: SparkSession, folder: str) -> DataFrame:
    parts = chunks(chapters(spark, folder).withColumnRenamed("idx", "chapter_idx"), ["book_id", "chapter_id", "chapter_idx", "title"])
    return parts.withColumn("chunk_id", F.col("chapter_id") * 1000 + F.col("idx"))


CHUNKS = f"""{CHAPTERS}, sized AS (SELECT *, length(text) AS len, CASE WHEN length(text) <= 1200 THEN 1 ELSE CAST(ceil((length(text) - 1200) / 1080.0) AS INTEGER) + 1 END AS w FROM chapters WHERE length(text) > 0),
counted AS (SELECT *, (w > 1 AND len - (w - 1) * 1080 < 200) AS joined, w - CAST((w > 1 AND len - (w - 1) * 1080 < 200) AS INTEGER) AS cnt FROM sized),
numbered AS (SELECT *, unnest(range(1, cnt + 1)) AS k FROM counted),
cut AS (SELECT book_id, chapter_id, idx AS chapter_idx, title, CAST(k AS INTEGER) AS idx, chapter_id * 1000 + k AS chunk_id,
  substr(text, (k - 1) * 1080 + 1, 1200) || CASE WHEN k = cnt AND joined THEN substr(text, k * 1080 + 1, 1200) ELSE '' END AS chunk_text,
  CAST((k - 1) * 1080 AS INTEGER) AS start_pos, CAST(CASE WHEN k = cnt THEN len ELSE (k - 1) * 1080 + 1200 END AS INTEGER) AS end_pos FROM numbered),
chunks AS (SELECT *, CAST(length(chunk_text) AS INTEGER) AS token_count FROM cut)"""


def narrations(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions: a draft of 0.3 of each chapter, and one of 0.5 where the document is labelled good."""
    ch = chapters(spark, folder)
    good = table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("chapter_id")).distinct()
    first = ch.withColumn("version", F.lit(1)).withColumn("ratio", F.lit(0.3))
    second = ch.join(good, "chapter_id", "left_semi").withColumn("version", F.lit(2)).withColumn("ratio", F.lit(0.5))
    rows = first.unionByName(second)
    return rows.select(
        (F.col("chapter_id") * 10 + F.col("version")).alias("narration_id"), "book_id", "chapter_id", F.col("idx").alias("chapter_idx"), "title", "version",
        draft(F.col("text"), F.col("ratio")).alias("narration_text"), F.concat(F.lit("v"), "version").alias("prompt_version"), (F.col("version") * 100).alias("created_at"),
    )


BLANKS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


NARRATIONS = f"""{CHAPTERS}, versions AS (SELECT c.*, 1 AS version, 0.3::DOUBLE AS ratio FROM chapters c UNION ALL
  SELECT c.*, 2, 0.5::DOUBLE FROM chapters c WHERE chapter_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
narrations AS (SELECT chapter_id * 10 + version AS narration_id, book_id, chapter_id, idx AS chapter_idx, title, version,
  {stripped("substr(text, 1, greatest(1, CAST(floor(length(text) * ratio) AS INTEGER)))")} AS narration_text, 'v' || version AS prompt_version, version * 100 AS created_at FROM versions)"""


def days(spark: SparkSession, folder: str) -> DataFrame:
    """Events by user and day: book_id, chapter_idx (day of the month), pos, event_id, event_type, value, name, props."""
    e = table(spark, folder, "events")
    day = F.dayofmonth("ts")
    return e.select(F.col("user_id").alias("book_id"), day.alias("chapter_idx"), F.col("event_id").alias("pos"), "event_id", "event_type", "value", F.concat(F.lit("N"), F.col("event_id") % 7).alias("name"), "props")


DAYS = "days AS (SELECT user_id AS book_id, CAST(day(ts) AS INTEGER) AS chapter_idx, event_id AS pos, event_id, event_type, value, 'N' || (event_id % 7) AS name, props FROM events)"


def characters(spark: SparkSession, folder: str) -> DataFrame:
    """Seven names a user; even ones have an alias `n<k> x` that claims use."""
    users = table(spark, folder, "events").select(F.col("user_id").alias("book_id")).distinct()
    rows = users.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return rows.select("book_id", F.col("k").cast("long").alias("character_id"), F.concat(F.lit("Hero"), "k").alias("canonical_name"), F.when(F.col("k") % 2 == 0, F.concat(F.lit('["N'), "k", F.lit('"]'))).otherwise("[]").alias("aliases_json"))


CHARACTERS = """characters AS (SELECT book_id, CAST(k AS BIGINT) AS character_id, 'Hero' || k AS canonical_name,
  CASE WHEN k % 2 = 0 THEN '["N' || k || '"]' ELSE '[]' END AS aliases_json FROM (SELECT DISTINCT user_id AS book_id FROM events), range(0, 7) r(k))"""
