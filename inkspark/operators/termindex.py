"""A stored inverted index of notes' terms, for related notes and link candidates without reading the notes.

Tables below a folder, all Parquet:

* ``forward``: m, path, links and bag of every note: its distinct words, each
  with its count as a term (0 if it is none) and as a significant word (1 for
  each row of the path that has it); in the order of ``m``;
* ``notes``: path, m, id, norm, sorted by path: a note's numbers, and the norm of
  its TF-IDF weights. A term's impact in a note is its count times its idf over
  the norm, so that two notes' cosine is the sum of the products of their impacts;
* ``postings``: bucket, term, block, df, best, lists of ids and of both
  counts: a term's notes by falling impact (in levels), ``BLOCK`` to a
  block, with a bound of the block's counts over norms; every million notes have
  blocks of their own;
* ``terms``: bucket, term, df, top: the first blocks' df and bound;
* ``links``: src, dst: which notes link to which.

``bucket`` is a directory, so a query opens only those of its terms. What is
stored are counts and numbers; impacts, which do not pack, are computed.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..lineage import remove, stored
from . import termlists

BLOCK = 128
#: Postings in a bucket, so that one query's terms open few of them.
PER_BUCKET = 2_000_000
#: Tasks that lay out a bucket.
SLICES = 4
#: Postings of a note's terms up to which all are summed at once.
AT_ONCE = 500_000
#: Notes whose own terms are read to score them.
FEW = 5_000
#: Scores are rounded to six digits; what could round to the threshold is kept.
MARGIN = 2e-6


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


class TermIndex:
    """The index below ``folder``, built by ``TermIndex.build``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        about = spark.read.parquet(f"{folder}/about").first()
        self.notes, self.buckets, self.forward = about.notes, about.buckets, about.forward
        self.tables: dict[str, DataFrame] = {}  # opened once: listing and reading schemas take longer than a small query

    @classmethod
    def build(cls, notes: DataFrame, folder: str, block: int = BLOCK, per_bucket: int = PER_BUCKET) -> TermIndex:
        """Write the index of ``notes`` (path, content). A folder that holds one already is an error."""
        spark = notes.sparkSession
        building = f"{folder}/building"
        forward, total = termlists.bags(notes, f"{folder}/forward")  # texts are read once: everything else reads this
        held = spark.read.parquet(forward)
        buckets = max(1, -(-(held.agg(F.sum("size")).first()[0] or 0) // per_bucket))
        sums = stored(termlists.sums(termlists.numbered(held), total).select("id", F.sqrt("squares").alias("norm")), f"{building}/norms")
        known = termlists.numbered(held.select("m", "path")).join(sums, "id", "left").select("path", "m", "id", "norm")
        stored(known.repartitionByRange("path").sortWithinPartitions("path"), f"{folder}/notes")
        near = F.broadcast(sums) if total <= termlists.FEW_NOTES else sums
        lists = termlists.by_impact(termlists.numbered(held).join(near, "id", "left").withColumn("norm", F.coalesce("norm", F.lit(0.0))))
        slices = F.expr(f"pmod(xxhash64(term) div {buckets}, {SLICES})")
        laid = termlists.blocks(lists.withColumn("bucket", _bucket(buckets)), buckets * SLICES, F.col("bucket") * SLICES + slices, block)
        postings = stored(laid, f"{folder}/postings", ("bucket",))
        stored(postings.where("block = 0").select("bucket", "term", "df", F.col("best").alias("top")), f"{folder}/terms", ("bucket",))
        stored(termlists.resolved(held).where("dst is not null").select("src", "dst").distinct(), f"{folder}/links")
        spark.createDataFrame([(total, buckets, forward.rsplit("/", 1)[1])], "notes long, buckets int, forward string").coalesce(1).write.parquet(f"{folder}/about")
        remove(spark, building)
        return cls(spark, folder)

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(f"{self.folder}/{self.forward if name == 'forward' else name}")
        return self.tables[name]

    def idf(self, df: int) -> float:
        return math.log(self.notes / df) + 1

    def vector(self, path: str) -> list[Row]:
        """bucket, term, df, top and impact of a note's own terms."""
        me = self.read("notes").where(F.col("path") == path).first()
        if me is None or not me.norm:
            return []
        mine = self.read("forward").where(F.col("m") == me.m).select(F.inline("bag")).where("n > 0").select("term", F.col("n").alias("own")).withColumn("bucket", _bucket(self.buckets))
        known = self.read("terms").join(F.broadcast(mine), ["bucket", "term"]).groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("top").alias("top"), F.first("own").alias("own")).collect()
        return [Row(bucket=r.bucket, term=r.term, df=r.df, top=r.top * self.idf(r.df), impact=r.own * self.idf(r.df) / me.norm) for r in known]

    def asked(self, vector: list[Row]) -> DataFrame:
        """term, own, rest: a vector's terms with their impact times idf, and what all others of them can add to a score at most."""
        total = sum(r.impact * r.top for r in vector)
        return self.spark.createDataFrame(pa.table({"term": [r.term for r in vector], "own": [r.impact * self.idf(r.df) for r in vector], "rest": [total - r.impact * r.top for r in vector]}))

    def postings(self, vector: list[Row]) -> DataFrame:
        """The blocks of a vector's terms, with ``own`` and ``rest``."""
        held = sorted({r.bucket for r in vector})
        return self.read("postings").where(F.col("bucket").isin(held)).join(F.broadcast(self.asked(vector)), "term")

    def threshold(self, path: str, blocks: DataFrame, limit: int) -> float:
        """A score that the ``limit`` nearest notes reach, from the highest block of each term; 0 if there are fewer."""
        below = self.summed(blocks.where("block = 0"), path).orderBy(F.desc("dot")).limit(limit).collect()
        return below[-1].dot if len(below) == limit else 0.0

    def possible(self, path: str, vector: list[Row], least: float) -> DataFrame:
        """The notes that can reach the score ``least``.

        Terms whose highest impacts together stay under it are left aside: a
        note that has no other term cannot reach it. Of the others' blocks those
        are read whose best note, with all that the other terms could add, can.
        """
        aside, added = set(), 0.0
        for r in sorted(vector, key=lambda r: r.impact * r.top):
            if added + r.impact * r.top >= least - MARGIN:
                break
            aside.add(r.term)
            added += r.impact * r.top
        blocks = self.postings([r for r in vector if r.term not in aside])
        # a note in a block that is not read cannot reach it anyway; of a note in none of those all is read but what stands aside
        read = blocks.where(F.col("own") * F.col("best") + F.col("rest") + added >= least - MARGIN)
        return self.summed(read, path).where(F.col("dot") + added >= least - MARGIN).select("path")

    def scores(self, path: str, limit: int, at_once: int = AT_ONCE) -> DataFrame:
        """path, score of the notes that can be among the ``limit`` nearest to ``path``, exact for those that are.

        Up to ``at_once`` postings of the note's terms are summed at once. Of
        more, the highest blocks give a threshold, the notes that can reach it
        are found, and if they are few their own terms give their scores; else
        all postings are summed after all.
        """
        vector = self.vector(path)
        if not vector:
            return self.spark.createDataFrame([], "path string, score double")
        blocks = self.postings(vector)
        if sum(r.df for r in vector) > at_once:
            found = [r.path for r in self.possible(path, vector, self.threshold(path, blocks, limit)).limit(FEW + 1).collect()]
            if len(found) <= FEW:
                near = self.read("forward").where(F.col("path").isin(found)).select("m", F.inline("bag")).where("n > 0").join(F.broadcast(self.asked(vector)), "term")
                dots = near.groupBy("m").agg(F.sum(F.col("own") * F.col("n")).alias("dot"))
                return dots.join(self.read("notes"), "m").select("path", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
        return self.summed(blocks, path).select("path", F.round("dot", 6).alias("score"))

    def related(self, path: str, limit: int = 8) -> DataFrame:
        """path, score, linked of the nearest notes by TF-IDF cosine, as ``search.related`` gives them."""
        links = self.read("links").where((F.col("src") == path) | (F.col("dst") == path))
        near = links.select(F.explode(F.array("src", "dst")).alias("path")).where(F.col("path") != path).distinct().withColumn("linked", F.lit(True))
        best = self.scores(path, limit).where("score > 0").orderBy(F.desc("score"), "path").limit(limit)
        return best.join(near, "path", "left").select("path", "score", F.coalesce("linked", F.lit(False)).alias("linked")).orderBy(F.desc("score"), "path")

    def candidates(self, texts: DataFrame, limit: int = 8) -> DataFrame:
        """id, path, score, rank: the notes that share most of each text's (id, text) significant terms."""
        asked = texts.select("id", md.significant_terms("text").alias("terms")).where(F.size("terms") > 0)
        words = asked.select("id", F.size("terms").alias("size"), F.explode("terms").alias("term")).withColumn("bucket", _bucket(self.buckets))
        has = self.read("postings").select("bucket", "term", "ids", "word").join(words, ["bucket", "term"]).select("id", "size", F.explode(F.arrays_zip("ids", "word")).alias("r")).where("r.word > 0")
        shared = has.groupBy("id", "size", F.col("r.ids").alias("note")).agg(F.sum("r.word").alias("shared"))
        named = shared.join(self.read("notes").select(F.col("id").alias("note"), "path"), "note")
        scored = named.select("id", "path", F.round(F.col("shared") / F.col("size"), 6).alias("score"))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "path"))).where(F.col("rank") <= limit)
        return ranked.select("id", "path", "score", "rank")

    def summed(self, blocks: DataFrame, path: str) -> DataFrame:
        """path, dot of every other note in the blocks."""
        rows = blocks.select("own", F.explode(F.arrays_zip("ids", "n")).alias("r")).where("r.n > 0")
        dots = rows.groupBy(F.col("r.ids").alias("id")).agg(F.sum(F.col("own") * F.col("r.n")).alias("dot"))
        return dots.join(self.read("notes"), "id").where(F.col("path") != path).select("path", (F.col("dot") / F.col("norm")).alias("dot"))
