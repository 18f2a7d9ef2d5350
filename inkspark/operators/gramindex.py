"""A stored index of three-letter grams, for literal and pattern search without reading all notes.

Tables below a folder, all Parquet:

* ``texts``: shelf, id, path, title, content: the notes by number, in
  directories of ``shelf`` numbers and small pages, so that a few ids read a few pages;
* ``grams``: bucket, gram, n: in how many notes a gram is;
* ``postings``: bucket, gram, chunk, ids: the notes with a gram among ``CHUNK`` numbers.

A gram is three signs of the folded title and text, folded so that whatever a
search in any case takes as equal is equal. A note that holds a run of letters
holds all its grams; the notes that do are looked at, and no others. No row
holds more than ``CHUNK`` ids, however common the gram.

Defined results: a null content is searched by its title as ``search.search``
does; notes with one path are one row each; an empty collection finds nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.names import c
from ..functions.patterns import needed
from ..lineage import cut
from .rewrite import numbered
from .search import classify, found_in, nothing_found, valid

CHUNK = 4096
#: Characters of a text that one row of grams is taken from; longer texts are taken in several.
PIECE = 1 << 16
#: Postings in a bucket, so that one query's grams open few of them.
PER_BUCKET = 2_000_000
#: Directories of texts at most; small collections have one for each chunk.
SHELVES = 4096
#: The rarest grams of an alternative whose postings are met. Others would only drop more of what is looked at.
MET = 6
#: Notes found whose numbers go into the condition on the stored texts; more are joined.
FEW = 1000
#: Numbers that a condition names one by one; a longer list would reach the scan as its least and greatest only.
NAMED = 10


def folded(text: Column | str) -> Column:
    """A text in which letters that differ in case only are one: lower, upper and lower again, one sigma, no dot above.

    The replacements stand between the changes of case: of two in a row the
    optimiser keeps the outer one alone, which is not the same for all letters.
    """
    plain = F.replace(F.lower(c(text)), F.lit("\u0307"), F.lit(""))
    return F.lower(F.replace(F.upper(plain), F.lit("Σ"), F.lit("σ")))


def grams(text: Column | str) -> Column:
    """All runs of three signs of a text, each once."""
    return F.array_distinct(F.regexp_extract_all(c(text), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def _pieces(text: Column, piece: int) -> Column:
    """A text in parts that overlap by two signs, so that every gram lies in one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(piece))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(piece + 2)))


#: Columns of the stored tables: one of no notes has no files from which to read them.
SCHEMAS = {
    "texts": "id long, path string, title string, content string, shelf int",
    "grams": "gram string, n long, bucket int",
    "postings": "gram string, chunk long, ids array<long>, bucket int",
}


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")


class GramIndex:
    """The index below ``folder``, built by ``GramIndex.build``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        about = spark.read.parquet(f"{folder}/about").first()
        self.notes, self.buckets, self.shelf, self.chunk = about.notes, about.buckets, about.shelf, about.chunk
        self.tables: dict[str, DataFrame] = {}

    @classmethod
    def build(cls, notes: DataFrame, folder: str, chunk: int = CHUNK, piece: int = PIECE, per_bucket: int = PER_BUCKET) -> GramIndex:
        """Write the index of ``notes`` (path, content). A folder that holds one already is an error."""
        spark = notes.sparkSession
        rows = numbered(notes.select("path", md.title("path", "content").alias("title"), "content"), "path", "id")
        total = rows.count()
        shelf = max(1, math.ceil(total / chunk / SHELVES)) * chunk
        laid = rows.withColumn("shelf", F.expr(f"id div {shelf}")).repartitionByRange("id").sortWithinPartitions("id")
        # small row groups and pages: their least and greatest ids let a scan pass over the rest
        laid.write.option("parquet.block.size", str(8 << 20)).option("parquet.page.size", str(64 << 10)).option("parquet.page.row.count.limit", "64").partitionBy("shelf").parquet(f"{folder}/texts")
        stored = spark.read.schema(SCHEMAS["texts"]).parquet(f"{folder}/texts")
        # a piece is a row before its grams are taken: no array holds a long text's grams
        whole = folded(F.concat_ws("\n", "title", "content"))
        parts = stored.select("id", F.explode(_pieces(whole, piece)).alias("part"))
        held = parts.select("id", F.explode(grams("part")).alias("gram")).groupBy("gram", F.expr(f"id div {chunk}").alias("chunk")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
        held = cut(held)
        sizes = held.agg(F.sum(F.size("ids")).alias("n")).first()
        buckets = max(1, -(-(sizes.n or 0) // per_bucket))
        placed = held.withColumn("bucket", _bucket(buckets))
        placed.repartitionByRange("bucket", "gram", "chunk").sortWithinPartitions("bucket", "gram", "chunk").write.partitionBy("bucket").parquet(f"{folder}/postings")
        counts = held.groupBy("gram").agg(F.sum(F.size("ids")).cast("long").alias("n")).withColumn("bucket", _bucket(buckets))
        counts.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/grams")
        about = "notes long, buckets int, shelf long, chunk int"
        spark.createDataFrame([(total, buckets, shelf, chunk)], about).coalesce(1).write.parquet(f"{folder}/about")
        return cls(spark, folder)

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        return self.tables[name]

    def chosen(self, text: str) -> list[list[str]] | None:
        """For each alternative of a search its rarest grams; None where an alternative has none, so all notes are to be read.

        An alternative with a gram that no note holds is left out: nothing matches it.
        """
        kind, needle = classify(text)
        runs = [[needle]] if kind == "literal" else [sorted(a) for a in needed(needle)]
        each = F.array_distinct(F.flatten(F.transform("runs", lambda r: grams(folded(r)))))
        wanted = [r.grams for r in self.spark.createDataFrame([(r,) for r in runs], "runs array<string>").select(each.alias("grams")).collect()]
        if not all(wanted):
            return None
        asked = self.spark.createDataFrame([(g,) for g in sorted({g for gs in wanted for g in gs})], "gram string").withColumn("bucket", _bucket(self.buckets)).collect()
        buckets, names = sorted({r.bucket for r in asked}), [r.gram for r in asked]
        known = {r.gram: r.n for r in self.read("grams").where(F.col("bucket").isin(buckets) & F.col("gram").isin(names)).collect()}
        return [sorted(gs, key=lambda g: (known[g], g))[:MET] for gs in wanted if all(g in known for g in gs)]

    def candidates(self, alternatives: list[list[str]]) -> DataFrame:
        """id of the notes that hold all grams of an alternative: their lists of a chunk are met, never more than a chunk's ids at once."""
        rows = [(i, g, len(gs)) for i, gs in enumerate(alternatives) for g in gs]
        asked = self.spark.createDataFrame(rows, "alt int, gram string, wanted int").withColumn("bucket", _bucket(self.buckets))
        buckets = sorted({r.bucket for r in asked.collect()})
        lists = self.read("postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(sorted({r[1] for r in rows}))).drop("bucket").join(F.broadcast(asked.drop("bucket")), "gram")
        met = lists.groupBy("alt", "chunk", "wanted").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("wanted"))
        both = F.aggregate(F.slice("lists", 2, MET), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
        return met.select(F.explode(both).alias("id")).distinct()

    def looked_at(self, text: str) -> DataFrame:
        """The stored notes that a search can match: path, title, content."""
        alternatives = self.chosen(text)
        texts = self.read("texts")
        if alternatives is None:
            return texts
        if not alternatives:
            return texts.where("false")
        found = self.candidates(alternatives)
        few = sorted(r.id for r in found.limit(FEW + 1).collect())
        if len(few) > FEW:
            return texts.join(found, "id", "left_semi")
        if not few:
            return texts.where("false")
        named = None
        for i in range(0, len(few), NAMED):
            some = F.col("id").isin(few[i : i + NAMED])
            named = some if named is None else named | some
        return texts.where(F.col("shelf").isin(sorted({i // self.shelf for i in few})) & named)

    def search(self, text: str) -> DataFrame:
        """path, title, snippet, as ``search.search`` gives them for the notes that were indexed."""
        kind, needle = classify(text) or ("none", "")
        if kind == "none" or kind == "regex" and not valid(self.spark, needle):
            return nothing_found(self.read("texts"))
        return found_in(self.looked_at(text), kind, needle)
