"""Changes to a whole table of notes: upsert, rename, move, delete, replace.

Each function returns the new table or a preview; nothing is written here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.names import clean_folder, folder, slug, stem
from ..lineage import cut


def upsert(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """``notes`` with the rows of ``changes`` (same columns) in place of those with the same path."""
    return notes.join(changes.select("path"), "path", "left_anti").select(notes.columns).unionByName(changes.select(notes.columns))


def open_or_create(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, created for each wanted path."""
    here = notes.select("path", F.lit(False).alias("created"))
    return wanted.select("path").join(here, "path", "left").select("path", F.coalesce("created", F.lit(True)).alias("created"))


def free_paths(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """pos, path: a free path for each (pos, folder, title), suffixed `` 2``, `` 3`` where taken.

    All names that could meet are folded in order, those of one folder and root
    after each other; the root is the slug without trailing numbers, so ``X``
    and ``X 2`` come together. Only the names of one root are held.
    """
    root = F.regexp_replace("stem", r"( \d+)+$", "")
    asked = wanted.select("pos", clean_folder("folder").alias("folder"), slug("title").alias("stem")).withColumn("root", root).withColumn("taken", F.lit(False))
    there = notes.select(F.lit(-1).cast("long").alias("pos"), folder("path").alias("folder"), stem("path").alias("stem")).withColumn("root", root).withColumn("taken", F.lit(True))
    there = there.join(asked.select("folder", "root").distinct(), ["folder", "root"], "left_semi").select(asked.columns)

    def fold(batches):
        import pandas as pd

        at, used, last = None, set(), {}
        for rows in batches:
            out = []
            for r in rows.itertuples():
                if (r.folder, r.root) != at:
                    at, used, last = (r.folder, r.root), set(), {}
                name = r.stem
                if not r.taken:
                    n = last.get(r.stem, 2)
                    while name in used:
                        name, n = f"{r.stem} {n}", n + 1
                    last[r.stem] = n
                    out.append((r.pos, f"{r.folder}/{name}.md" if r.folder else f"{name}.md"))
                used.add(name)
            yield pd.DataFrame(out, columns=["pos", "path"])

    both = asked.unionByName(there).select("pos", "folder", "stem", "root", "taken")
    dealt = both.repartition("folder", "root").sortWithinPartitions("folder", "root", F.desc("taken"), "pos", "stem")
    return dealt.mapInPandas(fold, "pos long, path string")


def _free(notes: DataFrame, path: str, into: str, title: str) -> str:
    """A free path for one note, which may keep its own."""
    row = notes.sparkSession.createDataFrame([(0, into, title)], "pos long, folder string, title string")
    return free_paths(notes.where(F.col("path") != path), row).first()["path"]


def rename(notes: DataFrame, path: str, new_title: str) -> DataFrame:
    """path, content, changed: a note under its new stem, numbered where another note has it, and links to it following."""
    old = path.rsplit("/", 1)[-1].removesuffix(".md")
    target = _free(notes, path, path.rpartition("/")[0], new_title)
    new = target.rsplit("/", 1)[-1].removesuffix(".md")
    # links are read without regard to case, so a change of case alone leaves them as they are
    text = F.col("content") if old.lower() == new.lower() else md.retarget("content", old, new)
    moved = F.when(F.col("path") == path, F.lit(target)).otherwise(F.col("path"))
    return notes.select(moved.alias("path"), text.alias("content"), (text != F.col("content")).alias("changed"))


def move(notes: DataFrame, path: str, into: str) -> DataFrame:
    """A note in another folder, numbered where another note has its name there."""
    target = _free(notes, path, into, path.rsplit("/", 1)[-1].removesuffix(".md"))
    return notes.withColumn("path", F.when(F.col("path") == path, F.lit(target)).otherwise(F.col("path")))


def folder_target(source: str, into: str) -> tuple[str, str]:
    """A folder and where it stands once it is moved; the root, itself and its own subtree are refused."""
    source, into = source.strip("/"), into.strip("/")
    if not source or into == source or into.startswith(source + "/") or ".." in source.split("/") + into.split("/"):
        raise ValueError("the folder cannot move there")
    return source, (into + "/" if into else "") + source.rsplit("/", 1)[-1]


def move_folder(notes: DataFrame, source: str, into: str) -> DataFrame:
    """Notes below ``source`` move below ``into``; a folder that is not there and a place that is taken are refused too."""
    source, to = folder_target(source, into)
    if not notes.where(F.col("path").startswith(source + "/")).limit(1).count():
        raise FileNotFoundError(f"no folder {source}")
    if to == source:
        return notes
    if notes.where(F.col("path").startswith(to + "/")).limit(1).count():
        raise FileExistsError(f"there is a folder {to}")
    inside = F.col("path").startswith(source + "/")
    return notes.withColumn("path", F.when(inside, F.concat(F.lit(to), F.substr("path", F.lit(len(source) + 1)))).otherwise(F.col("path")))


def delete_folder(notes: DataFrame, name: str) -> DataFrame:
    name = name.strip("/")
    if not name or ".." in name.split("/"):
        raise ValueError("this folder cannot be deleted")
    return notes.where(~F.col("path").startswith(name + "/"))


def deleted_with(notes: DataFrame, name: str) -> DataFrame:
    """path, title of the notes that go with a folder; their number is what the deletion reports."""
    delete_folder(notes, name)  # refuses what cannot be deleted
    return notes.where(F.col("path").startswith(name.strip("/") + "/")).select("path", md.title("path", "content").alias("title"))


def replace_preview(notes: DataFrame, find: str) -> DataFrame:
    """path, title, count of the notes that hold ``find``, case and all."""
    if not find:
        return notes.where("false").select("path", F.lit("").alias("title"), F.lit(0).cast("long").alias("count"))
    count = ((F.length("content") - F.length(F.replace("content", F.lit(find), F.lit("")))) / len(find)).cast("long")
    return notes.select("path", md.title("path", "content").alias("title"), count.alias("count")).where("count > 0")


def rename_preview(notes: DataFrame, find: str, replacement: str) -> DataFrame:
    """path, from, to of the notes whose name holds ``find``."""
    name = stem("path")
    new = F.replace(name, F.lit(find), F.lit(replacement))
    return notes.where(name.contains(find) & (F.trim(new) != "")).select("path", name.alias("old"), new.alias("new"))


def affected(notes: DataFrame, find: str, replacement: str, rename_notes: bool = True) -> DataFrame:
    """One row: notes that hold ``find``, how often in all, notes renamed, and notes touched at all.

    A renamed note often holds the text too, so the notes touched are counted
    once each, in one pass over the notes.
    """
    holds = F.length(F.replace("content", F.lit(find), F.lit(""))) if find else F.length("content")
    count = ((F.length("content") - holds) / max(1, len(find))).cast("long")
    new = F.replace(stem("path"), F.lit(find), F.lit(replacement))
    renamed = stem("path").contains(find) & (F.trim(new) != "") if find and rename_notes else F.lit(False)
    rows = notes.select(F.coalesce(count, F.lit(0)).alias("n"), renamed.alias("renamed"))
    return rows.agg(
        F.count_if(F.col("n") > 0).alias("hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_if("renamed").alias("renames"), F.count_if((F.col("n") > 0) | F.col("renamed")).alias("affected"),
    )


def replace_text(notes: DataFrame, find: str, replacement: str) -> DataFrame:
    return notes.withColumn("content", F.replace("content", F.lit(find), F.lit(replacement))) if find else notes


def replace_all(notes: DataFrame, find: str, replacement: str, rename_notes: bool) -> DataFrame:
    """was, path, content after renames with link repair, then replacement in all texts.

    A renamed note takes a free path in the order of paths, numbered where a
    note that stays, or one renamed before it, has the name; no note is lost.
    Links are repaired by a lookup of each link's target, so the work is one
    join and not one pass for each rename.
    """
    rows = notes.select(F.col("path").alias("was"), "path", "content")
    if find and rename_notes:
        named = rename_preview(notes, find, replacement)
        wanted = named.select("path", folder("path").alias("folder"), F.col("new").alias("title"))
        # places in the order of paths, from counts below each partition's rows
        wanted = numbered(wanted, "path")
        stay = notes.join(named.select("path"), "path", "left_anti")
        moved = wanted.select("pos", F.col("path").alias("was")).join(free_paths(stay, wanted), "pos").select("was", F.col("path").alias("to"))
        targets = moved.select(F.lower(stem("was")).alias("key"), "was", stem("to").alias("new")).where(F.col("key") != F.lower("new"))
        first = targets.groupBy("key").agg(F.min_by("new", "was").alias("new"))
        links = notes.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[\[([^\[\]|#^]+)"), F.lit(1)))).alias("raw"))
        swaps = links.withColumn("key", F.lower(F.trim("raw"))).join(first, "key").groupBy("path").agg(F.collect_list(F.struct("raw", "new")).alias("swaps"))

        def repaired(text, s):
            for end in ("]]", "|", "#", "^"):
                text = F.replace(text, F.concat(F.lit("[["), s["raw"], F.lit(end)), F.concat(F.lit("[[\0"), s["new"], F.lit(end)))
            return text

        # a repaired target is marked, so that no other rename takes hold of it
        fixed = F.replace(F.aggregate(F.coalesce("swaps", F.array().cast("array<struct<raw:string,new:string>>")), F.col("content"), repaired), F.lit("[[\0"), F.lit("[["))
        rows = notes.join(swaps, "path", "left").join(moved.withColumnRenamed("was", "path"), "path", "left")
        rows = rows.select(F.col("path").alias("was"), F.coalesce("to", "path").alias("path"), fixed.alias("content"))
    return replace_text(rows, find, replacement)


def numbered(rows: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """``rows`` with gapless numbers from 0 in the order of a column; no task sees more than its range.

    The ranges' sizes are summed over their numbers, of which there are as many
    as tasks.
    """
    dealt = cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    below = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(below), "_part").withColumn(name, (F.col("_below") + F.col("_within")).cast("long")).drop("_part", "_within", "_below")


def numbered_within(rows: DataFrame, key: str, order: str, name: str = "pos") -> DataFrame:
    """``rows`` with gapless numbers from 0 within each key, in the order of a column.

    Rows are sorted in ranges of (key, order), so a key of any size lies in as
    many tasks as it needs; the counts of the ranges give the numbers.
    """
    dealt = cut(rows.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("_at", F.monotonically_increasing_id()))
    parts = dealt.groupBy(key, F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a range holds whole keys but for its first and last, so all others begin where they stand
    below = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = parts.select(key, "_part", (F.coalesce(below, F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.withColumn("_part", F.shiftright("_at", 33)).join(shift, [key, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def unique_stems(titles: DataFrame) -> DataFrame:
    """pos, stem: the slug of each title, counted on from 2 until it is free of what came before, in any case.

    Names that could meet have one root, the name without trailing numbers.
    Where all of a root's names are one, its rows are numbered in ranges, however
    many they are. Only roots with several names (``X`` beside ``X 2``) are
    folded in order, each in one task that holds the names of one root.
    """
    stems = titles.select("pos", slug("title").alias("stem")).withColumn("key", F.lower("stem")).withColumn("root", F.regexp_replace("key", r"( \d+)+$", ""))
    several = stems.groupBy("root").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("root")
    plain = numbered_within(stems.join(several, "root", "left_anti").select("pos", "stem", "key"), "key", "pos", "n")
    alone = plain.select("pos", F.when(F.col("n") == 0, F.col("stem")).otherwise(F.concat("stem", F.lit(" "), (F.col("n") + 1).cast("string"))).alias("stem"))

    def fold(batches):
        import pandas as pd

        at, used, last = None, set(), {}
        for rows in batches:
            out = []
            for pos, stem, key, root in rows.itertuples(index=False):
                if root != at:
                    at, used, last = root, set(), {}
                name, n = stem, last.get(key, 2)
                while name.lower() in used:
                    name, n = f"{stem} {n}", n + 1
                last[key] = n
                used.add(name.lower())
                out.append((pos, name))
            yield pd.DataFrame(out, columns=["pos", "stem"])

    mixed = stems.join(several, "root", "left_semi").select("pos", "stem", "key", "root").repartition("root").sortWithinPartitions("root", "pos")
    return alone.unionByName(mixed.mapInPandas(fold, "pos long, stem string"))
