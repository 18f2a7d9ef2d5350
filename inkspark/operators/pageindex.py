"""A stored table of pages, of which a query reads only the parts that can hold an answer.

Below a folder, all Parquet:

* ``pages/n=…/home=…/bin=…``: path, title, fields, tags, by path; a leaf folder is a part, a range of paths;
* ``parts/n=…``: part, count, lo, hi, tags: every part of a version, its first
  and last path, and a Bloom filter (a bitmap) of its tags and the tags above them;
* ``keys/n=…``: bucket, part, key, and what a part's values of a field are: how
  many, how many of them numbers, the least and greatest number and text.

A query keeps the parts whose range meets its folder, whose filter has its tag
and whose values can meet its condition; only those are listed and read. There
are at most ``MAX_PARTS`` parts, so their names fit the driver; of few parts all
are read without asking.

``refresh`` takes changed and deleted notes. It parses the changed ones only,
writes the parts anew whose ranges they lie in, and then the list of parts, by
which readers go; parts of the version before stay for readers that began with it.

Defined results: those of ``dql.run`` over the notes indexed. Rows without a
path are no notes; rows of one path are pages of their own, and a change
replaces all of them; a null content is an empty text; other columns are not read;
an index of nothing answers with no rows.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..lineage import numbers, remove
from ..plans import dql

#: Pages of a part, and the number of parts from which on parts grow instead.
PER_PART, MAX_PARTS = 2048, 50_000
#: Up to so many parts are read without asking which can answer.
FEW = 4
#: Bits of a bitmap, as Spark's bitmap functions have it, and places of a tag in it.
BITS, PLACES = 1 << 15, 3
#: Folders of the table of keys.
BUCKETS = 64
#: Characters of texts that are kept as least and greatest.
SHORT = 32

PAGES = "path string, title string, fields map<string,string>, tags array<string>"


def _places(tag: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(tag, F.lit(i)), F.lit(BITS)) for i in range(PLACES)])


def _with_above(tags: Column | str) -> Column:
    """Tags and all tags above them, each once."""

    def above(tag: Column) -> Column:
        steps = F.split(tag, "/")
        return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))

    return F.array_distinct(F.flatten(F.transform(tags, above)))


def _may_have(bits: Column, tag: str) -> Column:
    """Whether a bitmap holds all places of a tag."""
    has = F.lit(True)
    for i in range(PLACES):
        at = F.pmod(F.xxhash64(F.lit(tag), F.lit(i)), F.lit(BITS))
        byte = F.conv(F.hex(F.substr(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        has = has & (F.bit_get(byte, (at % 8).cast("int")) == 1)
    return has


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _may_hold(op: str, wanted: str) -> Column:
    """Whether a part (count; held, numeric, lo, hi, text_lo, text_hi of a field's values) can meet a condition."""
    x, text = md.number(F.lit(wanted)), F.lit(wanted.lower()[:SHORT])

    def within(lo: str, hi: str, value: Column, slack: float | None) -> Column:
        low, high = (F.col(lo), F.col(hi)) if slack is None else (F.col(lo) - slack, F.col(hi) + slack)
        match op:
            case "=":
                return (low <= value) & (value <= high)
            case ">" | ">=":
                return value <= high
            case "<" | "<=":
                return low <= value
        return F.lit(True)

    of_text = within("text_lo", "text_hi", text, None)
    of_numbers = within("lo", "hi", x, 2 * dql.EPSILON) & (F.col("numeric") > 0)
    some = F.when(x.isNull(), of_text).otherwise(F.coalesce(of_numbers, F.lit(False)) | ((F.col("held") > F.col("numeric")) & of_text))
    missing = F.lit(dql.true_of_nothing(op, wanted)) & (F.coalesce("held", F.lit(0)) < F.col("count"))
    return F.coalesce(some, F.lit(False)) | missing


class PageIndex:
    """The last version of the index below ``folder``, written by ``PageIndex.build``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.version = numbers(spark, f"{folder}/parts")[-1]
        self.per_part = spark.read.parquet(f"{folder}/about").first().per_part
        self.stored = spark.read.schema("part string, count long, lo string, hi string, tags binary").parquet(f"{folder}/parts/n={self.version}")
        self.parts = self.stored.select("part", "count", "lo", "hi").orderBy("lo").collect()

    @classmethod
    def build(cls, notes: DataFrame, folder: str, per_part: int = PER_PART) -> PageIndex:
        """Write an index of ``notes`` (path, content). A folder that holds one already is an error."""
        spark = notes.sparkSession
        total = notes.count()
        size = max(per_part, math.ceil(total / MAX_PARTS))
        spark.createDataFrame([(size,)], "per_part long").coalesce(1).write.parquet(f"{folder}/about")
        _write(_parsed(notes).withColumn("home", F.lit(0)), folder, 0, math.ceil(total / size)).write.parquet(f"{folder}/parts/n=0")
        return cls(spark, folder)

    def read(self, parts: list[str]) -> DataFrame:
        """The pages of some parts."""
        if not parts:
            return self.spark.createDataFrame([], PAGES)
        return self.spark.read.schema(PAGES).parquet(*[f"{self.folder}/pages/{p}" for p in parts])

    def chosen(self, query: dql.Query) -> list[str]:
        """The parts that can hold a page of a query's answer."""
        left = [p for p in self.parts if _meets(query.source, p.lo, p.hi)]
        tag = query.source[1] if query.source and query.source[0] == "tag" else None
        key = dql.key_of(query.where[0]) if query.where else None
        key = None if key in (*dql.OF_PATH, "title") else key
        if len(left) <= FEW or tag is None and key is None:
            return [p.part for p in left]
        rows = self.stored if len(left) == len(self.parts) else self.stored.where((F.col("hi") >= left[0].lo) & (F.col("lo") <= left[-1].hi))
        if tag is not None:
            rows = rows.where(F.coalesce(_may_have(F.col("tags"), tag), F.lit(False)))
        if key is not None:
            values = _keys(self.spark, self.folder, sorted({int(p.part.split("/")[0][2:]) for p in left}))
            known = values.where((F.col("bucket") == _bucket(F.lit(key))) & (F.col("key") == key)).drop("bucket", "key")
            rows = rows.select("part", "count").join(known, "part", "left").where(_may_hold(*query.where[1:]))
        found = {r.part for r in rows.select("part").collect()}
        return [p.part for p in left if p.part in found]

    def run(self, text: str) -> dql.Result:
        """Answer a query text, as ``dql.run`` does over the notes that were indexed."""
        try:
            query = dql.parse(text)
        except dql.QueryError as mistake:
            return dql.Result("error", error=str(mistake))
        return dql.answer(self.read(self.chosen(query)), query)

    def refresh(self, written: DataFrame, deleted: DataFrame | None = None) -> PageIndex:
        """The next version: ``written`` (path, content) in place of what their paths had, ``deleted`` (path) gone."""
        before = numbers(self.spark, f"{self.folder}/parts")
        version = self.version + 1
        gone = written.select("path") if deleted is None else written.select("path").unionByName(deleted.select("path"))
        touched = gone.where("path is not null").distinct()
        home = _home([p.lo.encode() for p in self.parts])
        homes = {r.home for r in touched.select(home("path").alias("home")).distinct().collect()}
        stale = [p for i, p in enumerate(self.parts) if i in homes]
        # parts that lost most of their pages are merged by writing all anew
        if len(self.parts) > 2 * math.ceil(sum(p["count"] for p in self.parts) / self.per_part) + 16:
            stale, home = list(self.parts), None
        rows = self.read([p.part for p in stale]).join(touched, "path", "left_anti").unionByName(_parsed(written))
        total = sum(p["count"] for p in stale) + written.count()
        placed = rows.withColumn("home", F.lit(0) if home is None else home("path"))
        fresh = _write(placed, self.folder, version, math.ceil(total / self.per_part))
        names = self.spark.createDataFrame([(p.part,) for p in stale], "part string")
        self.stored.join(names, "part", "left_anti").unionByName(fresh).write.mode("overwrite").parquet(f"{self.folder}/parts/n={version}")
        if len(before) > 1:
            was = {r.part for r in self.spark.read.parquet(f"{self.folder}/parts/n={before[-2]}").select("part").collect()}
            for part in was - {p.part for p in self.parts}:
                remove(self.spark, f"{self.folder}/pages/{part}")
            remove(self.spark, f"{self.folder}/parts/n={before[-2]}")
        return PageIndex(self.spark, self.folder)


def _meets(source: tuple[str, str] | None, lo: str, hi: str) -> bool:
    """Whether a range of paths can hold a folder's."""
    if not source or source[0] != "folder" or not source[1]:
        return True
    name, first, last = (x.encode() for x in (source[1], source[1] + "/", source[1] + "0"))
    return lo.encode() <= name <= hi.encode() or lo.encode() < last and hi.encode() >= first


def _home(firsts: list[bytes]):
    """Which part a path belongs to: the last that begins at it or before, else the first."""

    @F.pandas_udf("int")
    def home(path: pd.Series) -> pd.Series:
        return path.map(lambda p: max(0, bisect.bisect_right(firsts, p.encode()) - 1)).astype("int32")

    return home


def _parsed(notes: DataFrame) -> DataFrame:
    return dql.pages(notes.where("path is not null").select("path", F.coalesce("content", F.lit("")).alias("content"))).select("path", "title", "fields", "tags")


def _keys(spark: SparkSession, folder: str, versions: list[int]) -> DataFrame:
    schema = "part string, key string, held long, numeric long, lo double, hi double, text_lo string, text_hi string, bucket int"
    return spark.read.schema(schema).option("basePath", f"{folder}/keys").parquet(*[f"{folder}/keys/n={n}" for n in versions]).drop("n")


def _write(pages: DataFrame, folder: str, version: int, parts: int) -> DataFrame:
    """Write pages (with ``home``) as parts of a version, and what their values are; the rows of the list of parts."""
    spark = pages.sparkSession
    laid = pages.repartitionByRange(max(1, parts), "home", "path").sortWithinPartitions("home", "path")
    laid.withColumn("bin", F.spark_partition_id()).write.mode("overwrite").partitionBy("home", "bin").parquet(f"{folder}/pages/n={version}")
    stored = spark.read.schema(PAGES + ", home int, bin int").parquet(f"{folder}/pages/n={version}")
    named = stored.withColumn("part", F.format_string(f"n={version}/home=%d/bin=%d", "home", "bin"))
    values = named.select("part", F.explode("fields").alias("key", "value")).where(~F.col("key").isin(*dql.OF_PATH, "title"))
    number, short = md.number(F.col("value")), F.substring(F.lower("value"), 1, SHORT)
    real = F.when(~F.isnan(number), number)
    about = values.groupBy("part", "key").agg(
        F.count(F.lit(1)).alias("held"), F.count(real).alias("numeric"), F.min(real).alias("lo"), F.max(real).alias("hi"), F.min(short).alias("text_lo"), F.max(short).alias("text_hi")
    )
    about.withColumn("bucket", _bucket(F.col("key"))).repartitionByRange("bucket", "key", "part").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/keys/n={version}")
    ranges = named.groupBy("part").agg(F.count(F.lit(1)).alias("count"), F.min("path").alias("lo"), F.max("path").alias("hi"))
    places = named.select("part", F.explode(_with_above("tags")).alias("tag")).select("part", F.explode(_places(F.col("tag"))).alias("place"))
    bits = places.groupBy("part").agg(F.bitmap_construct_agg("place").alias("tags"))
    return ranges.join(bits, "part", "left").coalesce(1)
