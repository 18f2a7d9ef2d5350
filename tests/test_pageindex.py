"""The stored page index against queries over the notes themselves."""

import random

import pytest
from pyspark.sql import functions as F

from inkspark.operators.pageindex import PageIndex
from inkspark.plans import dql
from inkspark.sources import derived

DATA = "/root/testdata/sf0.001"
QUERIES = (
    'TABLE n_chars, quality FROM #doc WHERE n_chars >= 3000 SORT n_chars DESC LIMIT 20',
    'LIST author FROM "en" WHERE quality = 1',
    "TABLE file.name, source FROM #topic WHERE toxic != 1",
    "LIST FROM #topic/2",
    'LIST WHERE source > "SRC15"',
    'LIST WHERE quality = ""',
    'LIST WHERE nowhere < ""',
    'LIST WHERE author = "AI"',
    'LIST FROM "de/src3" SORT title',
    'LIST FROM #nothing/here',
    'TABLE title WHERE title > "doc 9"',
    'LIST FROM "zz"',
)


def rows(result):
    return sorted(tuple(map(str, r)) for r in result.frame.collect())


@pytest.fixture(scope="module")
def table(spark):
    return derived.notes(spark, DATA).select("path", "content").cache()


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return PageIndex.build(table, str(tmp_path_factory.mktemp("pages") / "ix"), per_part=32)


@pytest.mark.parametrize("text", QUERIES)
def test_equals_the_scan(table, index, text):
    assert rows(index.run(text)) == rows(dql.run(table, text))


def test_only_parts_that_can_answer_are_read(spark, tmp_path):
    """Of twenty folders one has the tag, one the field, and values rise with the folder."""
    data = [(f"f{f:02}/{i:03}.md", f"---\nrank: {f * 100 + i}\nword: w{f:02}\n---\n{'#rare/one' if f == 7 else '#plain'}\n{'Only:: x' if f == 3 else ''}\n") for f in range(20) for i in range(40)]
    notes = spark.createDataFrame(data, "path string, content string")
    index = PageIndex.build(notes, str(tmp_path / "ix"), per_part=40)
    most = {"LIST FROM #rare": 2, "LIST FROM #rare/one": 2, "LIST FROM #rare/two": 1, "LIST WHERE only = x": 2, "LIST WHERE rank > 1890": 2, "LIST WHERE rank = 512": 2, 'LIST FROM "f11"': 2, "LIST WHERE word < w01": 3, "LIST FROM #rare WHERE rank < 100": 1}
    assert len(index.parts) >= 16
    for text, n in most.items():
        assert len(index.chosen(dql.parse(text))) <= n, text
        assert rows(index.run(text)) == rows(dql.run(notes, text)), text
    assert len(index.chosen(dql.parse('LIST WHERE only = ""'))) == len(index.parts) - 1  # that with the field in all its pages


def test_refresh_follows_changes(spark, table, tmp_path):
    """After each batch of changes the index answers as the notes do; untouched parts stay."""
    index = PageIndex.build(table, str(tmp_path / "ix"), per_part=16)
    current = {r.path: r.content for r in table.collect()}
    chance = random.Random(7)
    for turn in range(5):
        picked = chance.sample(sorted(current), 4)
        written = {p: current[p].replace("n_chars: ", "n_chars: 9") + "\n#fresh\n" for p in picked[:2]} | {f"new/{turn}.md": "---\nquality: 1\n---\nSource:: src99\n"}
        current = {p: c for p, c in (current | written).items() if p not in picked[2:]}
        kept = {p.part for p in index.parts}
        index = index.refresh(spark.createDataFrame(list(written.items()), "path string, content string"), spark.createDataFrame([(p,) for p in picked[2:]], "path string"))
        assert len(kept & {p.part for p in index.parts}) >= len(kept) - 6
        now = spark.createDataFrame(list(current.items()), "path string, content string")
        for text in ("LIST FROM #fresh", 'TABLE n_chars WHERE source = "src99"', "TABLE quality, n_chars WHERE n_chars > 90000") if turn < 4 else (*QUERIES, "LIST FROM #fresh"):
            assert rows(index.run(text)) == rows(dql.run(now, text)), text
    assert PageIndex(spark, index.folder).version == 5


def test_awkward_rows(spark, tmp_path):
    """Null contents and paths, repeated paths, numbers that are none, very long values, clashing columns, no notes."""
    long = "ü" * 70000
    data = [("a.md", "v:: nan", 1), ("b.md", "v:: inf\n", 1), ("c.md", None, 1), ("a.md", "v:: 3", 1), ("d.md", f"v:: {long}", 1), (None, "v:: 3", 1), ("e/f.md", "v:: ", 1), ("é.md", "v:: -inf", 1)]
    notes = spark.createDataFrame(data, "path string, content string, home int")
    index = PageIndex.build(notes, str(tmp_path / "ix"), per_part=1)
    clean = notes.where("path is not null").select("path", F.coalesce("content", F.lit("")).alias("content"))
    for text in ("LIST WHERE v = 3", "LIST WHERE v > 2", "LIST WHERE v < 0", "LIST WHERE v != 3", f'LIST WHERE v = "{long}"', "LIST WHERE v >= uuu", "LIST", 'LIST WHERE v = ""', 'LIST FROM "e"', "LIST WHERE v = nan"):
        assert rows(index.run(text)) == rows(dql.run(clean, text)), text
    assert index.run("TASK").error == dql.UNSUPPORTED
    index = index.refresh(spark.createDataFrame([("a.md", "v:: 4")], "path string, content string"))
    assert rows(index.run("TABLE v WHERE v >= 3")) == [("a.md", "['4']"), ("b.md", "['inf']"), ("d.md", f"['{long}']")]
    none = PageIndex.build(notes.where("false"), str(tmp_path / "none"))
    assert none.run("LIST").frame.count() == none.run("LIST FROM #x WHERE y = 1").frame.count() == 0
    assert none.refresh(clean).run("LIST").frame.count() == 7
