"""Notes, versions and posts derived from the driver's tables.

The formulas are SQL text that Spark and DuckDB read alike, so a query and its
SQL twin begin from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH = "lang || '/' || source || '/Doc ' || CAST(doc_id AS STRING) || '.md'"
CONTENT = r"""
'---' || chr(10) || 'tags: [doc, lang/' || lang || ']' || chr(10) || 'n_chars: ' || CAST(n_chars AS STRING) || chr(10)
|| CASE WHEN quality IS NULL THEN '' ELSE 'quality: ' || CAST(quality AS STRING) || chr(10) || 'toxic: ' || CAST(toxic AS STRING) || chr(10) END
|| CASE WHEN doc_id % 4 = 0 THEN 'author: ai' || chr(10) || 'ai_client: ' || CASE WHEN doc_id % 8 = 0 THEN 'scribe' ELSE 'drafter' END || chr(10) ELSE '' END
|| '---' || chr(10) || '# Doc ' || CAST(doc_id AS STRING) || chr(10) || chr(10) || text || chr(10) || chr(10)
|| 'Source:: ' || source || chr(10)
|| 'See [[Doc ' || CAST((doc_id * 7 + 3) % n_all AS STRING) || ']] and [[doc ' || CAST((doc_id * 13 + 5) % n_all AS STRING) || '|see]]'
|| CASE WHEN doc_id % 3 = 0 THEN ' and [[Doc ' || CAST((doc_id * 7 + 3) % n_all AS STRING) || '#top]]' ELSE '' END
|| CASE WHEN doc_id % 5 = 0 THEN ' and [[Missing ' || CAST(doc_id % 11 AS STRING) || ']]' ELSE '' END
|| CASE WHEN doc_id % 10 = 0 THEN ' and [[Doc ' || CAST(doc_id AS STRING) || ']]' ELSE '' END || chr(10)
|| CASE WHEN doc_id % 7 = 0 THEN 'see Doc ' || CAST((doc_id * 3 + 1) % n_all AS STRING) || ' today' || chr(10) ELSE '' END
|| CASE WHEN doc_id % 6 = 0 THEN 'tagged #topic/' || CAST(doc_id % 3 AS STRING) || chr(10) ELSE '' END
"""
MODIFIED = "1700000000000 + doc_id * 1000"

#: DuckDB: the note tables as leading CTEs.
NOTES_CTE = f"""
base AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, (SELECT count(*) FROM documents) AS n_all
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
notes AS (SELECT {PATH} AS path, {CONTENT} AS content, {MODIFIED} AS modified, doc_id FROM base)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Labels up to which they are broadcast, so that no text is shuffled to meet them.
FEW_LABELS = 1_000_000


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, modified of a note for each document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    total = docs.select(F.count(F.lit(1))).scalar()
    near = F.broadcast(labels) if labels.count() <= FEW_LABELS else labels
    base = docs.select("doc_id", "text", "lang", "source", "n_chars").join(near, "doc_id", "left").withColumn("n_all", total)
    return base.selectExpr(f"{PATH} AS path", f"{CONTENT} AS content", f"{MODIFIED} AS modified")


def chat_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each conversation, its turns in order."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("**"), r["role"], F.lit(":** "), F.coalesce(r["text"], F.lit("")))), "\n")
    front = F.when(F.exists("rows", lambda r: r["role"] == "assistant"), "---\nauthor: ai\n---\n").otherwise("")
    return rows.select(F.format_string("Chat/conv %d.md", "conv_id").alias("path"), F.concat(front, body).alias("content"), F.lit(0).cast("long").alias("modified"))


def day_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily note for each day of events."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    rows = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), F.date_format(r["ts"], "HH:mm"), F.lit(" "), r["event_type"])), "\n")
    return rows.select(F.concat(F.lit("Journal/"), "day", F.lit(".md")).alias("path"), body.alias("content"), F.lit(0).cast("long").alias("modified"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, taken_at (ms), tie, content: an event log as a snapshot log."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("taken_at"),
        F.col("event_id").alias("tie"),
        F.col("event_type").alias("content"),
    )


#: DuckDB: the same snapshot log.
SNAPSHOTS_CTE = """
snaps AS (
  SELECT 'u/' || CAST(user_id AS VARCHAR) || '.md' AS path, epoch_us(ts) // 1000 AS taken_at, event_id AS tie, event_type AS content
  FROM events)
"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as blog posts: the title element, host as author, first path segment as category."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").alias("pos"),
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.col("url").alias("link"),
        F.lit("").alias("date"),
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("author"),
        F.col("page_id").alias("author_id"),
        F.col("html").alias("content_html"),
        F.array(F.regexp_extract("url", r"^https?://[^/]+/([^/?]*)", 1)).alias("categories"),
        F.array().cast("array<string>").alias("tags"),
    )


POSTS_CTE = r"""
posts AS (
  SELECT page_id AS pos, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, url AS link,
         regexp_extract(url, '^https?://([^/]+)', 1) AS author, html AS content_html,
         regexp_extract(url, '^https?://[^/]+/([^/?]*)', 1) AS category
  FROM pages)
"""
