"""Full-text search, unlinked mentions, and similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.names import c, quoted
from ..lineage import remove, scratch, stored, writing
from . import termlists
from .graph import backlinks, resolved
from .mentions import all_mentions


__all__ = ["all_mentions", "classify", "dead_links", "found_in", "highlighted", "link_candidates", "linked_pairs", "nothing_found", "related", "search", "suggestions", "unlinked_mentions", "valid"]


def classify(text: str) -> tuple[str, str] | None:
    """(kind, needle) of a search text: a literal, or a Java pattern with its flags; None if blank."""
    raw = text.strip()
    if not raw:
        return None
    if raw.startswith("re:") and len(raw) > 3:
        return "regex", raw[3:]
    slashed = re.fullmatch(r"/((?:\\.|[^\\/])+)/([ims]*)", raw, re.DOTALL)
    if slashed:
        return "regex", (f"(?{''.join(sorted(set(slashed[2])))})" if slashed[2] else "") + slashed[1]
    return "literal", raw


def valid(spark: SparkSession, pattern: str) -> bool:
    """Whether Java takes a pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def nothing_found(titled: DataFrame) -> DataFrame:
    return titled.where("false").select("path", "title", F.lit("").alias("snippet"))


def found_in(titled: DataFrame, kind: str, needle: str) -> DataFrame:
    """path, title, snippet of the rows (path, title, content) that a literal or a pattern matches."""
    if kind == "literal":
        low = needle.lower()
        hit = F.lower("title").contains(low) | F.lower("content").contains(low)
        return titled.where(hit).select("path", "title", md.snippet("content", needle).alias("snippet"))
    pattern = "(?U)" + needle
    return titled.where(F.col("title").rlike(pattern) | F.col("content").rlike(pattern)).select("path", "title", md.regex_snippet("content", pattern).alias("snippet"))


def search(notes: DataFrame, text: str) -> DataFrame:
    """path, title, snippet of every note whose title or text matches; a bad pattern matches nothing."""
    titled = notes.select("path", md.title("path", "content").alias("title"), "content")
    kind, needle = classify(text) or ("none", "")
    if kind == "none" or kind == "regex" and not valid(notes.sparkSession, needle):
        return nothing_found(titled)
    return found_in(titled, kind, needle)


def highlighted(text: Column | str, sought: str) -> Column:
    """array<struct(text, hit)>: a text in parts, those that a search found marked; a blank search marks nothing.

    Literals are found in any case. What stands between the hits is what a
    split at them leaves, so parts and hits alternate; empty ones are left out.
    """
    kind, needle = classify(sought) or ("none", "")
    whole = F.array(F.struct(c(text).alias("text"), F.lit(False).alias("hit")))
    if kind == "none":
        return whole
    pattern = F.lit("(?U)" + needle if kind == "regex" else "(?iu)" + quoted(needle))
    between = F.transform(F.split(c(text), pattern, -1), lambda x: F.struct(x.alias("text"), F.lit(False).alias("hit")))
    hits = F.transform(F.regexp_extract_all(c(text), pattern, F.lit(0)), lambda x: F.struct(x.alias("text"), F.lit(True).alias("hit")))
    return F.filter(F.flatten(F.zip_with(between, hits, lambda a, b: F.array(a, b))), lambda p: p.isNotNull() & (p["text"] != ""))


def unlinked_mentions(notes: DataFrame, path: str, name: str) -> DataFrame:
    """Notes that name ``name`` without linking to it: path, title, snippet, count."""
    if len(name) < 3:
        return notes.where("false").select("path", F.lit("").alias("title"), F.lit("").alias("snippet"), F.lit(0).cast("long").alias("count"))
    bare = notes.where(F.col("path") != path).select("path", md.title("path", "content").alias("title"), md.links("content").alias("links"), md.without_links("content").alias("text"))
    free = bare.where(~F.exists("links", lambda x: F.lower(x) == name.lower())).withColumn("count", md.mentions("text", name).cast("long"))
    return free.where("count > 0").select("path", "title", md.snippet("text", name).alias("snippet"), "count")


def related(notes: DataFrame, path: str, limit: int = 8) -> DataFrame:
    """Notes closest to ``path`` by TF-IDF cosine: path, score, linked.

    Texts are read once. Every note's norm takes the notes of every term, so
    counts go by term and sums come back by note, as lists; what is stored for
    that is deleted, since the answer has ``limit`` rows at most.
    """
    spark = notes.sparkSession
    folder = scratch(spark, "related")
    bags, total = termlists.bags(notes, f"{folder}/bags")
    held = spark.read.parquet(bags)
    mine = held.where(F.col("path") == path).select(F.inline("bag")).where("n > 0").select("term", F.col("n").alias("own"))
    met = stored(termlists.sums(termlists.numbered(held), total, mine), f"{folder}/sums").where("dot > 0")
    met = met.join(termlists.numbered(held.select("m", "path")).select("id", "path"), "id")
    own = F.sqrt(met.where(F.col("path") == path).agg(F.max("squares")).scalar())
    scored = met.where(F.col("path") != path).select("path", F.round(F.col("dot") / (F.sqrt("squares") * own), 6).alias("score")).where("score > 0")
    near = termlists.neighbours(held, path).withColumn("linked", F.lit(True))
    best = scored.orderBy(F.desc("score"), "path").limit(limit).join(near, "path", "left")
    with writing(spark):
        rows = best.select("path", "score", F.coalesce("linked", F.lit(False)).alias("linked")).orderBy(F.desc("score"), "path").collect()
    remove(spark, folder)
    return spark.createDataFrame(rows, "path string, score double, linked boolean").coalesce(1)


def link_candidates(notes: DataFrame, texts: DataFrame, limit: int = 8) -> DataFrame:
    """For each text (id, text) the notes that share most of its significant terms."""
    asked = texts.select("id", md.significant_terms("text").alias("terms")).where(F.size("terms") > 0)
    words = asked.select("id", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    has = notes.select("path", F.explode(md.significant_terms(F.concat(md.title("path", "content"), F.lit(" "), F.col("content")))).alias("term"))
    scored = words.join(has, "term").groupBy("id", "size", "path").agg(F.count(F.lit(1)).alias("shared")).select("id", "path", F.round(F.col("shared") / F.col("size"), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "path"))).where(F.col("rank") <= limit)
    return ranked.select("id", "path", "score", "rank")


def suggestions(targets: DataFrame, names: DataFrame, limit: int = 3, least: float = 0.3) -> DataFrame:
    """For each distinct target the closest names by Dice score above ``least``: target, name, score, rank.

    Names and targets meet on shared character pairs, each pair known by its
    text and number of occurrence, so that counting meetings is the multiset
    intersection.
    """

    def bigrams(frame: DataFrame, column: str) -> DataFrame:
        text = F.lower(column)
        pairs = F.when(F.length(text) >= 2, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        rows = frame.select(column).distinct().withColumn("pairs", pairs)
        counted = rows.select(column, F.size("pairs").alias("size"), F.posexplode("pairs").alias("pos", "pair"))
        return counted.withColumn("nth", F.row_number().over(Window.partitionBy(column, "pair").orderBy("pos"))).drop("pos")

    left, right = bigrams(targets, "target"), bigrams(names, "name").withColumnRenamed("size", "size2")
    score = F.when(F.lower("target") == F.lower("name"), 1.0).otherwise(2.0 * F.count(F.lit(1)) / (F.first("size") + F.first("size2")))
    scored = left.join(right, ["pair", "nth"]).groupBy("target", "name").agg(F.round(score, 6).alias("score")).where(F.col("score") > least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "name"))).where(F.col("rank") <= limit)


def dead_links(notes: DataFrame) -> DataFrame:
    """Links without a note, with how often each occurs: target, n."""
    return resolved(notes).where("dst is null").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def linked_pairs(notes: DataFrame) -> DataFrame:
    """Unordered pairs of notes of which one links to the other."""
    return backlinks(notes).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
