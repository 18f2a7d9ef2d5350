"""Daily notes: opened for days, seeded from a template, and given captured lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import appended, capture_line, clean_folder, template, trim_white


def _place(folder: str, day: Column) -> Column:
    inside = clean_folder(F.lit(folder))
    return F.concat(F.when(inside == "", "").otherwise(F.concat(inside, F.lit("/"))), day, F.lit(".md"))


def open_days(notes: DataFrame, days: DataFrame, folder: str, seed: str = "") -> DataFrame:
    """path, content, created: the daily note of each day in ``days`` (at timestamp).

    A note that is there stays as it is. Another is made from the template
    ``seed``, filled with the earliest time asked for on its day, or begins with
    the day as its heading. Null times are left out; a day asked for twice is
    one note, and so are rows of ``notes`` with one path (that with the least content).
    """
    asked = days.where("at is not null").groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.min("at").alias("at"))
    fresh = template(F.lit(seed), "day", F.col("at")) if seed else F.concat(F.lit("# "), "day", F.lit("\n\n"))
    wanted = asked.select(_place(folder, F.col("day")).alias("path"), fresh.alias("fresh"))
    there = notes.join(wanted.select("path"), "path", "left_semi").groupBy("path").agg(F.min(F.coalesce("content", F.lit(""))).alias("content"))
    return wanted.join(there, "path", "left").select("path", F.coalesce("content", "fresh").alias("content"), F.col("content").isNull().alias("created"))


def capture(notes: DataFrame, lines: DataFrame, folder: str, stamped: bool = True) -> DataFrame:
    """path, content, created: daily notes after the ``lines`` (at, text) of their days, in the order of time, then text.

    Each line stands after a blank line, with its time in front if ``stamped``.
    Blank texts are left out. All lines of a day come together in one row, as
    they do in the note.
    """
    kept = lines.where(F.col("at").isNotNull() & (trim_white("text") != ""))
    line = capture_line(F.col("at"), "text") if stamped else trim_white("text")
    rows = kept.select(F.date_format("at", "yyyy-MM-dd").alias("day"), F.struct("at", "text", line.alias("line")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n\n")
    added = rows.groupBy("day").agg(joined.alias("added")).select(_place(folder, F.col("day")).alias("path"), "added")
    opened = open_days(notes, kept.select("at"), folder)
    return opened.join(added, "path").select("path", appended("content", "added").alias("content"), "created")
