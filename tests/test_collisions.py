"""Names that meet: in imports, renames and moves."""

import pytest
from pyspark.sql import functions as F

from inkspark.operators import importing, rewrite
from inkspark.vault import Vault

POST = "pos long, title string, link string, date string, author string, author_id long, content_html string, categories array<string>, tags array<string>"


def posts(spark, *rows):
    return spark.createDataFrame([(i, t, "", "", a, 0, "<p>x</p>", c, g) for i, (t, a, c, g) in enumerate(rows)], POST)


def stems(spark, *titles):
    rows = spark.createDataFrame(list(enumerate(titles)), "pos long, title string")
    return [r.stem for r in rewrite.unique_stems(rows).orderBy("pos").collect()]


def by_hand(titles):
    used, out = set(), []
    for t in titles:
        name, n = t, 2
        while name.lower() in used:
            name, n = f"{t} {n}", n + 1
        used.add(name.lower())
        out.append(name)
    return out


@pytest.mark.parametrize("titles", [["A", "A", "A 2"], ["A 2", "A", "A"], ["A 2", "a", "A", "A 2", "A 2 2"], ["x", "X", "x"], ["A", "B", "A 2", "A 2", "a 2", "A"], ["A 2 2", "A 2", "A 2", "A"]])
def test_numbered_until_free(spark, titles):
    assert stems(spark, *titles) == by_hand(titles)


def test_one_title_many_times(spark):
    got = stems(spark, *["Same"] * 3000, "Other", "other")
    assert got[:3000] == ["Same", *[f"Same {i}" for i in range(2, 3001)]] and got[3000:] == ["Other", "other 2"]


def test_empty_titles(spark):
    assert stems(spark, "", "  ", "Untitled 2") == ["Untitled", "Untitled 2", "Untitled 2 2"]


def test_no_post_is_lost(spark):
    made = importing.notes_of(posts(spark, ("A", "", ["c"], []), ("A", "", ["d"], []), ("A 2", "", ["c"], [])), "Blog")
    paths = sorted(r.path for r in made.where("kind = 'post'").collect())
    assert paths == ["Blog/c/A 2 2.md", "Blog/c/A.md", "Blog/d/A 2.md"]


def test_one_hub_a_path(spark):
    """A name that is category, tag and author: the author's hub is written last. A hub stands over a post of its path."""
    made = importing.notes_of(posts(spark, ("T", "cat", ["cat"], ["cat"]), ("cat", "", [], [])), "Blog").collect()
    hub = [r for r in made if r.path == "Blog/cat.md"]
    assert len(hub) == 1 and hub[0].kind == "hub" and "Autor mit 1" in hub[0].content
    assert len({r.path for r in made}) == len(made)


def test_last_block_is_the_authors(spark, notes):
    done = importing.import_into(notes(("own/cat.md", "# mine")), posts(spark, ("T", "cat", ["cat"], []), ("U", "", ["cat"], [])), "Blog")
    text = done.where("action = 'block'").first().content
    assert "[[T]]" in text and "[[U]]" not in text


def test_rename_and_move_leave_others_alone(notes):
    table = notes(("x/A.md", "see [[A]]"), ("x/B.md", "b"), ("y/A.md", "other"), ("z/C.md", "[[a|x]]"))
    renamed = rewrite.rename(table, "x/A.md", "B")
    assert sorted(r.path for r in renamed.collect()) == ["x/B 2.md", "x/B.md", "y/A.md", "z/C.md"]
    assert {r.path: r.content for r in renamed.collect()}["z/C.md"] == "[[B 2|x]]"
    assert sorted(r.path for r in rewrite.move(table, "x/A.md", "y").collect()) == ["x/B.md", "y/A 2.md", "y/A.md", "z/C.md"]
    assert sorted(r.path for r in rewrite.move(table, "x/A.md", "x").collect()) == ["x/A.md", "x/B.md", "y/A.md", "z/C.md"]
    assert "A.md" in {r.path for r in rewrite.move(table, "x/A.md", "").collect()}


def test_folders_are_not_merged(notes):
    table = notes(("a/x.md", ""), ("a/b/y.md", ""), ("c/a/z.md", ""), ("d/w.md", ""))
    assert sorted(r.path for r in rewrite.move_folder(table, "a", "d").collect()) == ["c/a/z.md", "d/a/b/y.md", "d/a/x.md", "d/w.md"]
    with pytest.raises(FileExistsError):
        rewrite.move_folder(table, "a", "c")
    with pytest.raises(FileNotFoundError):
        rewrite.move_folder(table, "none", "c")
    for into in ("a", "a/b"):
        with pytest.raises(ValueError):
            rewrite.move_folder(table, "a", into)
    assert rewrite.move_folder(table, "a/b", "a").count() == 4


def test_vault_folders(spark, tmp_path):
    vault = Vault(spark, str(tmp_path), allow_write=True)
    vault.write_note("a/b/n.md", "text")
    vault.write_note("c/m.md", "more")
    assert vault.create_folder(" new:/ .. /x? ") == "new-/x-"
    with pytest.raises(ValueError):
        vault.create_folder(" / .. ")
    assert vault.move_folder("a/b", "c") == "c/b"
    assert sorted(r.path for r in vault.notes().select("path").collect()) == ["c/b/n.md", "c/m.md"]
    vault.write_note("b/o.md", "third")
    with pytest.raises(FileExistsError):
        vault.move_folder("b", "c")
    with pytest.raises(FileNotFoundError):
        vault.move_folder("nowhere", "c")


def test_numbers_within_keys(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.lit(5000) - F.col("id")).alias("o")).withColumn("k", F.when(F.col("o") < 4000, 0).otherwise(F.col("k")))
    got = rewrite.numbered_within(rows, "k", "o").collect()
    for key in (0, 1, 2):
        mine = sorted((r.o, r.pos) for r in got if r.k == key)
        assert [p for _, p in mine] == list(range(len(mine)))
