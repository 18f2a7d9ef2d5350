"""Daily notes, blocks of notes, labels, and reports of what a change touches."""

import datetime as dt

from pyspark.sql import functions as F

from inkspark.functions import markdown as md
from inkspark.functions import names as nm
from inkspark.operators import journal, rewrite


def at(text):
    return dt.datetime.fromisoformat(text)


def test_open_days(spark, notes):
    table = notes(("J/2026-01-02.md", "old"), ("2026-01-03.md", "elsewhere"), ("J/2026-01-05.md", None))
    days = spark.createDataFrame([(at("2026-01-02 08:00"),), (at("2026-01-03 09:30"),), (at("2026-01-03 07:15"),), (at("2026-01-05 01:00"),), (None,)], "at timestamp")
    assert sorted(map(tuple, journal.open_days(table, days, "J").collect())) == [("J/2026-01-02.md", "old", False), ("J/2026-01-03.md", "# 2026-01-03\n\n", True), ("J/2026-01-05.md", "", False)]
    filled = journal.open_days(table, days, "", "{{title}} {{time}}").where("created").orderBy("path").collect()
    assert [r.content for r in filled] == ["2026-01-02 08:00", "2026-01-05 01:00"]
    assert journal.open_days(table, days.limit(0), "J").count() == 0


def test_capture(spark, notes):
    table = notes(("J/2026-01-02.md", "old\n\n"), ("x.md", "y"))
    lines = spark.createDataFrame([(at("2026-01-02 08:05"), " two "), (at("2026-01-02 08:00"), "one"), (at("2026-01-02 09:00"), " \n"), (at("2026-01-04 10:00"), "z"), (None, "lost"), (at("2026-01-04 10:00"), None)], "at timestamp, text string")
    got = sorted(map(tuple, journal.capture(table, lines, "J").collect()))
    assert got == [("J/2026-01-02.md", "old\n\n- 08:00 one\n\n- 08:05 two\n", False), ("J/2026-01-04.md", "# 2026-01-04\n\n- 10:00 z\n", True)]
    assert [r.content for r in journal.capture(table, lines, "J", stamped=False).orderBy("path").collect()] == ["old\n\none\n\ntwo\n", "# 2026-01-04\n\nz\n"]


def test_split_and_join(spark):
    cases = {
        "---\na: 1\n---\n\n\nbody\n": ("---\na: 1\n---\n", "body\n"),
        "---\n---": ("---\n---", ""),
        "--- x\n--- y\nb": ("--- x\n--- y\n", "b"),
        "---\nnever closed": ("", "---\nnever closed"),
        " ---\na\n---\n": ("", " ---\na\n---\n"),
        "": ("", ""),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", md.split_front("t").alias("s")).select("t", "s.*", md.join_front("s.front", "s.body").alias("j")).collect()
    assert {r.t: (r.front, r.body) for r in rows} == cases
    assert {r.t: r.j for r in rows}["---\na: 1\n---\n\n\nbody\n"] == "---\na: 1\n---\n\nbody\n" and {r.t: r.j for r in rows}["---\nnever closed"] == "---\nnever closed"


def test_labels_and_links(spark):
    row = spark.range(1).select(nm.client_label(F.lit(None).cast("string")).alias("a"), nm.client_label(F.lit("cOdEx")).alias("b"), nm.client_label(F.lit("scribe")).alias("c"), nm.when_label(F.lit(1767342660000), "de").alias("d"), nm.when_label(F.lit(1767342660000), "fr").alias("e"), md.unescaped_links(F.lit(r"\[\[A\]\] \[b\] \*")).alias("f")).first()
    assert tuple(row) == ("AI", "Codex", "scribe", "02.01., 08:31", "02/01, 08:31", r"[[A]] \[b\] \*")


def test_affected(notes):
    table = notes(("x foo.md", "foo foo"), ("y foo.md", "none"), ("z.md", "foo"), ("w.md", None), ("foo.md", "x"))
    assert tuple(rewrite.affected(table, "foo", "").first()) == (2, 3, 2, 3)
    assert tuple(rewrite.affected(table, "foo", "bar").first()) == (2, 3, 3, 4)
    assert tuple(rewrite.affected(table, "foo", "bar", rename_notes=False).first()) == (2, 3, 0, 2)
    assert tuple(rewrite.affected(table, "", "bar").first()) == (0, 0, 0, 0)


def test_deleted_with(notes):
    table = notes(("a/b/x.md", "# T"), ("a/by.md", ""), ("a/b.md", ""))
    assert list(map(tuple, rewrite.deleted_with(table, "a/b").collect())) == [("a/b/x.md", "T")]
