"""The link graph: resolution, nodes and edges, neighbours, dead links, view metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.names import radius, stem


def hidden(folders: list[str]):
    """Predicate on ``path``: in one of the folders, or equal to it."""
    clean = [f.strip().strip("/") for f in folders]
    out = F.lit(False)
    for f in filter(None, clean):
        out = out | (F.col("path") == f) | F.col("path").startswith(f + "/")
    return out


def meta(notes: DataFrame) -> DataFrame:
    """path, title, ai_authored, ai_client, modified of every note."""
    return notes.select("path", md.title("path", "content").alias("title"), md.is_ai("content").alias("ai_authored"), md.ai_client("content").alias("ai_client"), "modified")


def names(notes: DataFrame) -> DataFrame:
    """name -> dst: which note a lower-cased link name leads to.

    Of notes that share a stem, the last in the order of titles.
    """
    keyed = notes.select(F.lower(stem("path")).alias("name"), "path", F.lower(md.title("path", "content")).alias("order"))
    return keyed.groupBy("name").agg(F.max_by("path", F.struct("order", "path")).alias("dst"))


def link_rows(notes: DataFrame) -> DataFrame:
    """src, pos, target, name: every link of every note."""
    return notes.select(F.col("path").alias("src"), F.posexplode(md.links("content")).alias("pos", "target")).withColumn("name", F.lower("target"))


def resolved(notes: DataFrame) -> DataFrame:
    """Links with ``dst``, null where no note answers to the name."""
    return link_rows(notes).join(names(notes), "name", "left")


def edges(notes: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """source, target of every link, repeats kept, links to oneself left out; ghosts are ``missing:name``."""
    seen = notes.where(~hidden(exclude or []))
    to = F.coalesce("dst", F.concat(F.lit("missing:"), F.col("name")))
    return resolved(seen).select(F.col("src").alias("source"), to.alias("target")).where("source <> target")


def ghosts(notes: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Link targets without a note: id, and the spelling that comes first in the order of titles."""
    seen = notes.where(~hidden(exclude or []))
    order = seen.select(F.col("path").alias("src"), F.lower(md.title("path", "content")).alias("order"))
    missing = link_rows(seen).join(names(seen), "name", "left_anti").join(order, "src")
    first = missing.groupBy("name").agg(F.min_by("target", F.struct("order", "src", "pos")).alias("title"))
    return first.select(F.concat(F.lit("missing:"), F.col("name")).alias("path"), "title")


def nodes(notes: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Notes and ghosts with their degree: every link end counts."""
    seen = notes.where(~hidden(exclude or []))
    degree = edges(notes, exclude).select(F.explode(F.array("source", "target")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("degree"))
    real = meta(seen).select("path", "title", "ai_authored", "ai_client", F.lit(False).alias("missing"))
    ghost = ghosts(notes, exclude).select("path", "title", F.lit(False).alias("ai_authored"), F.lit(None).cast("string").alias("ai_client"), F.lit(True).alias("missing"))
    return real.unionByName(ghost).join(degree, "path", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def backlinks(notes: DataFrame) -> DataFrame:
    """dst, src: each note that links to another, once."""
    return resolved(notes).where("dst is not null and dst <> src").select("dst", "src").distinct()


def backlinks_of(notes: DataFrame, path: str) -> DataFrame:
    """Notes that link to ``path``."""
    linking = resolved(notes).where((F.col("dst") == path) & (F.col("src") != path)).select(F.col("src").alias("path"))
    return meta(notes).join(linking, "path", "left_semi")


def outgoing(notes: DataFrame) -> DataFrame:
    """src, pos, name, dst: distinct targets in order of appearance, in their first spelling."""
    first = link_rows(notes).groupBy("src", "name").agg(F.min_by("target", "pos").alias("target"), F.min("pos").alias("pos"))
    return first.join(names(notes), "name", "left").select("src", "pos", "target", "dst")


def deletion_report(notes: DataFrame, path: str) -> DataFrame:
    """Notes whose links break when ``path`` goes."""
    return backlinks_of(notes, path).select("path", "title")


def view(notes: DataFrame) -> DataFrame:
    """Nodes with distinct incoming links, size tier, and their place among the hubs (first 14)."""
    incoming = edges(notes).groupBy("target").agg(F.countDistinct("source").alias("in_links")).withColumnRenamed("target", "path")
    sized = nodes(notes).join(incoming, "path", "left").withColumn("in_links", F.coalesce("in_links", F.lit(0)).cast("long"))
    hubs = sized.orderBy(F.desc("in_links"), F.desc("degree"), "path").limit(14)
    place = hubs.select("path", F.row_number().over(Window.orderBy(F.desc("in_links"), F.desc("degree"), "path")).alias("hub"))
    return sized.join(place, "path", "left").select("path", "degree", "in_links", radius("in_links").alias("radius"), "hub")


def pairs(notes: DataFrame) -> DataFrame:
    """Undirected node pairs that some link joins."""
    return edges(notes).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
