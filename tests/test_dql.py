"""The query language on small vaults."""

import pytest

from inkspark.plans import dql

BOOKS = (
    ("books/Moor.md", "---\ntags: [book]\nrating: 9\n---\n# Moor\nAuthor:: Ada Quill\n"),
    ("books/Emma.md", "---\ntags: [book, classic]\nrating: 7\n---\n# Emma\nAuthor:: Jane Austen\n"),
    ("inbox/Shopping.md", "# Shopping\nmilk #todo/home\n"),
)


def table(result):
    assert result.kind == "table", result.error
    return [list(r.row) for r in result.frame.collect()]


def items(result):
    return [r["item"] for r in result.frame.collect()]


def test_table_with_labels(notes):
    r = dql.run(notes(*BOOKS), 'TABLE rating AS "Stars", author FROM #book WHERE rating >= 8')
    assert r.columns == ["Stars", "author"]
    assert table(r) == [["9", "Ada Quill"]]


def test_list_folder_and_field(notes):
    frame = notes(*BOOKS)
    assert sorted(items(dql.run(frame, 'LIST FROM "books"'))) == ["[[Emma]]", "[[Moor]]"]
    assert items(dql.run(frame, "LIST author WHERE rating < 8 SORT rating")) == ["[[Shopping]]", "Jane Austen"]
    assert items(dql.run(frame, "LIST author WHERE rating = 9")) == ["Ada Quill"]


def test_nested_tag(notes):
    assert items(dql.run(notes(*BOOKS), "LIST FROM #todo")) == ["[[Shopping]]"]
    assert items(dql.run(notes(*BOOKS), "LIST FROM #TODO/home")) == ["[[Shopping]]"]
    assert items(dql.run(notes(*BOOKS), "LIST FROM #tod")) == []


def test_sort_and_limit(notes):
    frame = notes(*[(f"{n}.md", f"---\nrating: {v}\n---\n") for n, v in (("A", 9), ("B", 5), ("C", 10), ("D", "x"))], ("E.md", ""))
    assert items(dql.run(frame, "LIST SORT rating")) == ["[[E]]", "[[B]]", "[[A]]", "[[C]]", "[[D]]"]
    assert items(dql.run(frame, "LIST SORT rating DESC LIMIT 2")) == ["[[D]]", "[[C]]"]
    assert items(dql.run(frame, "LIST LIMIT 0")) == []
    assert len(items(dql.run(frame, "LIST LIMIT many"))) == 5


def test_non_ascii(notes):
    frame = notes(("möbel/Faust.md", "---\ngröße: 10\n---\n"))
    assert table(dql.run(frame, 'TABLE größe FROM "möbel" WHERE größe > 9')) == [["10"]]


def test_computed_fields_cannot_be_overridden(notes):
    frame = notes(("a/X.md", "---\nfile.name: other\ntitle: other\n---\n# Real\n"))
    assert table(dql.run(frame, "TABLE file.name, file.path, file.link, title")) == [["X", "a/X.md", "[[X]]", "Real"]]


def test_block_list_and_inline_list(notes):
    frame = notes(("X.md", '---\ntags:\n  - Alpha\n  - "beta"\npeople: [Ann, "Bo"]\n---\nKey::\nnext\n'))
    r = dql.pages(frame).first()
    assert r.tags == ["alpha", "beta"]
    assert r.fields["tags"] == "Alpha, beta" and r.fields["people"] == "Ann, Bo" and r.fields["key"] == "next"


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("TASK", "unsupported_query"),
        ("TABLE", "unsupported_query"),
        ("TABLE ,", "table_columns_required"),
        ("LIST WHERE rating", "where_comparison_required"),
        ("TABLE FROM #x", "unsupported_query"),
        ("TASK\nWHERE x", "where_comparison_required"),
    ],
)
def test_errors(notes, text, code):
    r = dql.run(notes(), text)
    assert (r.kind, r.error) == ("error", code)


def test_parser():
    q = dql.parse('TABLE a AS "A from b", c\nWHERE x = "y where z" SORT a b DESC\nFROM #T/u, more LIMIT 7')
    assert q.columns == (("a", "A from b"), ("c", "c"))
    assert q.where == ("x", "=", "y where z") and q.sort == ("a b", True) and q.source == ("tag", "t/u") and q.limit == 7
    assert dql.parse("LIST FROM nothing").source is None
    assert dql.parse('LIST WHERE a = "x>=y"').where[:2] == ('a = "x', ">=")


def test_numbers(notes):
    frame = notes(*[(f"{i}.md", f"v:: {v}\n") for i, v in enumerate(["5", "5.0", "1d", " +5", "nan", "inf", "abc", "1_0"])])
    assert sorted(items(dql.run(frame, "LIST v WHERE v = 5"))) == ["+5", "5", "5.0"]
    assert sorted(items(dql.run(frame, "LIST v WHERE v = inf"))) == []
    assert sorted(items(dql.run(frame, "LIST v WHERE v > 4"))) == ["+5", "5", "5.0", "abc", "inf"]
