"""A link graph that is kept from one batch of changed notes to the next.

Every table is a sum of signed rows: a batch appends what it takes away with
-1 and what it adds with +1, and the table is what sums to more than nothing.

* ``names``: name, path, order, title, ai_authored, ai_client: the notes by link name;
* ``out`` and ``into``: the links by source and by name: src, pos, target, name, order (of the source);
* ``edges``: source, target; ``degree``: path; ``ghosts``: name, title.

Rows lie in folders by hash of their first column. A batch reads the folders of
its own keys: the old links of changed notes, the notes behind the names that
these notes have or link to, and the links to a name only where the note
behind it changed or is missing. So the work follows the batch and those
links; a hub that many notes link to costs a reading when it comes, goes or
changes its place among notes of one name, and nothing when they do.

A batch is written under its number and then named complete, so one that runs
again writes the same folders again. Each ``every`` batches the tables are
summed up, and what came before the sum before that goes.

Defined results: those of ``graph`` over the current notes. Of several rows of
one path in a batch the last by ``modified`` counts; a null content deletes the
note, and deleting what is not there changes nothing; rows without a path are
no notes; other columns are not read; a batch of nothing changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import markdown as md
from ..functions.names import stem
from ..lineage import cut, numbers, remove
from ..operators.graph import link_rows

#: Folders of a table: so many that a batch's keys open few of them in a large collection.
BUCKETS = 64

TABLES = {
    "names": "name string, path string, `order` string, title string, ai_authored boolean, ai_client string",
    "out": "src string, pos int, target string, name string, `order` string",
    "into": "name string, src string, pos int, target string, `order` string",
    "edges": "source string, target string",
    "degree": "path string",
    "ghosts": "name string, title string",
}


class LiveGraph:
    """The graph kept below ``folder``; nothing there is a graph of no notes."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, every: int = 20):
        self.spark, self.folder, self.buckets, self.every = spark, folder, buckets, every
        self.last = max(numbers(spark, f"{folder}/done"), default=-1)

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _columns(self, table: str) -> list[str]:
        return [c.strip().split(" ")[0].strip("`") for c in TABLES[table].split(",")]

    def rows(self, table: str, keys: DataFrame | None = None, upto: int | None = None) -> DataFrame:
        """A table's rows with their number ``n``; with ``keys`` (one column) only those of these first columns."""
        upto = self.last if upto is None else upto
        whole = [n for n in numbers(self.spark, f"{self.folder}/{table}/whole") if n <= upto][-1:]
        since = [n for n in numbers(self.spark, f"{self.folder}/{table}/changes") if n <= upto and n > max(whole, default=-1)]
        places = [f"whole/n={n}" for n in whole] + [f"changes/n={n}" for n in since]
        columns = self._columns(table)
        if not places:
            return self.spark.createDataFrame([], TABLES[table] + ", n long")
        # a folder's number would be read in place of the rows' own, so each is a base by itself
        read = self.spark.read.schema(TABLES[table] + ", n long, bucket int")
        found = reduce(DataFrame.unionByName, [read.parquet(f"{self.folder}/{table}/{place}") for place in places])
        if keys is not None:
            key = keys.columns[0]
            wanted = sorted(r.b for r in keys.select(self._bucket(key).alias("b")).distinct().collect())
            found = found.where(F.col("bucket").isin(wanted)).join(keys.withColumnRenamed(key, columns[0]), columns[0], "left_semi")
        return found.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")

    def _append(self, table: str, changes: DataFrame, number: int) -> None:
        columns = self._columns(table)
        net = changes.groupBy(*columns).agg(F.sum("n").cast("long").alias("n")).where("n <> 0")
        net.withColumn("bucket", self._bucket(columns[0])).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{table}/changes/n={number}")

    def apply(self, batch: DataFrame, number: int | None = None) -> LiveGraph:
        """Take a batch of notes (path, content, modified; null content: deleted) into the graph."""
        number = self.last + 1 if number is None else number
        before = number - 1
        latest = batch.where("path is not null").groupBy("path").agg(F.max_by("content", F.struct("modified", "content")).alias("content"))
        latest = cut(latest)
        written = latest.where("content is not null")
        title = md.title("path", "content")
        own = F.lower(stem("path")).alias("name")
        new_notes = cut(written.select(own, "path", F.lower(title).alias("order"), title.alias("title"), md.is_ai("content").alias("ai_authored"), md.ai_client("content").alias("ai_client")))
        new_links = cut(link_rows(written).join(new_notes.select(F.col("path").alias("src"), "order"), "src").select(*self._columns("out")))
        changed = latest.select("path")
        old_links = cut(self.rows("out", changed, before).drop("n"))
        # links that stay as they are have no part in what follows, unless their name does
        minus, plus = old_links.withColumn("n", F.lit(-1)), new_links.withColumn("n", F.lit(1))
        delta = cut(minus.unionByName(plus).groupBy(*self._columns("out")).agg(F.sum("n").alias("n")).where("n <> 0"))
        names = cut(latest.select(own).union(delta.select("name")).distinct())

        there = cut(self.rows("names", names, before).drop("n"))
        stay = there.join(changed, "path", "left_anti").unionByName(new_notes)
        behind = lambda rows, to: rows.groupBy("name").agg(F.max_by("path", F.struct("order", "path")).alias(to))
        leads = names.join(behind(there, "was"), "name", "left").join(behind(stay, "now"), "name", "left")
        leads = cut(leads)

        # the links to names whose note changed, and to those that had none or have none now: their ghosts' titles may change
        asked = cut(leads.where("was is null or now is null or was <> now").select("name"))
        known = cut(self.rows("into", asked, before).drop("n"))
        moved = known.join(leads.where("not (was <=> now)"), "name")
        self_free = lambda rows, dst: rows.select(F.col("src").alias("source"), F.coalesce(dst, F.concat(F.lit("missing:"), F.col("name"))).alias("target"), "n").where("source <> target")
        # what stood leaves for the old note; what stands goes to the new one
        gone = delta.where("n < 0").join(leads, "name")
        come = delta.where("n > 0").join(leads, "name")
        kept = moved.join(delta.where("n < 0").select(*self._columns("into")), self._columns("into"), "left_anti")
        edges = self_free(gone, "was").unionByName(self_free(come, "now"))
        edges = cut(edges.unionByName(self_free(kept.withColumn("n", F.lit(-1)), "was")).unionByName(self_free(kept.withColumn("n", F.lit(1)), "now")))

        first = lambda rows: rows.groupBy("name").agg(F.min_by("target", F.struct("order", "src", "pos")).alias("title"))
        ghost_names = leads.where("now is null").select("name")
        left = known.join(delta.where("n < 0").select(*self._columns("into")), self._columns("into"), "left_anti").unionByName(delta.where("n > 0").select(*self._columns("into")))
        now_ghosts = first(left.join(ghost_names, "name", "left_semi"))
        ghosts = self.rows("ghosts", asked, before).select("name", "title", F.lit(-1).alias("n")).unionByName(now_ghosts.withColumn("n", F.lit(1)))

        renamed = there.join(changed, "path", "left_semi").withColumn("n", F.lit(-1)).unionByName(new_notes.withColumn("n", F.lit(1)))
        self._append("names", renamed, number)
        self._append("out", delta, number)
        self._append("into", delta, number)
        self._append("edges", edges, number)
        self._append("degree", edges.select(F.explode(F.array("source", "target")).alias("path"), "n"), number)
        self._append("ghosts", ghosts, number)
        self.last = number
        if (number + 1) % self.every == 0:
            self._sum_up(number)
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done/n={number}")
        return self

    def _sum_up(self, number: int) -> None:
        for table in TABLES:
            place = f"{self.folder}/{table}"
            before = [n for n in numbers(self.spark, f"{place}/whole") if n < number]
            self.rows(table, upto=number).withColumn("bucket", self._bucket(self._columns(table)[0])).write.mode("overwrite").partitionBy("bucket").parquet(f"{place}/whole/n={number}")
            for kind in ("whole", "changes"):
                for n in numbers(self.spark, f"{place}/{kind}"):
                    if before and (n < before[-1] or kind == "changes" and n == before[-1]):
                        remove(self.spark, f"{place}/{kind}/n={n}")

    # --- what the graph says ----------------------------------------------------

    def edges(self) -> DataFrame:
        """source, target and how many links join them, as ``graph.edges`` has them row by row."""
        return self.rows("edges")

    def degrees(self) -> DataFrame:
        return self.rows("degree").select("path", F.col("n").alias("degree"))

    def ghosts(self) -> DataFrame:
        return self.rows("ghosts").select(F.concat(F.lit("missing:"), F.col("name")).alias("path"), "title")

    def nodes(self) -> DataFrame:
        """As ``graph.nodes``."""
        real = self.rows("names").select("path", "title", "ai_authored", "ai_client", F.lit(False).alias("missing"))
        ghost = self.ghosts().select("path", "title", F.lit(False).alias("ai_authored"), F.lit(None).cast("string").alias("ai_client"), F.lit(True).alias("missing"))
        return real.unionByName(ghost).join(self.degrees(), "path", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def keep_graph(stream: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS, every: int = 20) -> StreamingQuery:
    """Keep a graph up to date with a stream of notes (path, content, modified)."""

    def save(batch: DataFrame, number: int) -> None:
        LiveGraph(batch.sparkSession, folder, buckets, every).apply(batch, number)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
