"""The stored term index against the scan it stands for."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkspark.operators import search, termlists
from inkspark.operators.termindex import TermIndex
from inkspark.sources import derived

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return derived.notes(spark, DATA).select("path", "content").cache()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    """Small blocks and several buckets, so that all tables are laid out as large ones are."""
    return TermIndex.build(table, str(tmp_path_factory.mktemp("index") / "terms"), block=4, per_bucket=2000)


def test_related_equals_the_scan(table, index):
    assert index.buckets > 1
    paths = sorted(r.path for r in table.select("path").collect())
    for path in random.Random(1).sample(paths, 4):
        assert [tuple(r) for r in index.related(path, 5).collect()] == [tuple(r) for r in search.related(table, path, 5).collect()]


def test_pruned_blocks_change_nothing(table, index):
    paths = sorted(r.path for r in table.select("path").collect())
    for path in random.Random(2).sample(paths, 3):
        best = lambda limit: [tuple(r) for r in index.scores(path, 3, limit).where("score > 0").orderBy(F.desc("score"), "path").limit(3).collect()]  # noqa: B023, E731
        assert best(0) == best(1 << 40)


def test_blocks_under_the_threshold_are_not_read(spark, tmp_path):
    """A rare word decides: of the notes that share only a common one, the lower blocks are left out."""
    rows = [(f"c{i}.md", "common " * (1 + i % 9) + " ".join(f"own{i}x{j}" for j in range(30))) for i in range(200)]
    rows += [("a.md", "common zebra quagga okapi"), ("b.md", "zebra quagga okapi and more"), ("d.md", "okapi zebra quagga")]
    notes = spark.createDataFrame(rows, "path string, content string")
    ix = TermIndex.build(notes, str(tmp_path / "ix"), block=4)
    vector = ix.vector("a.md")
    least = ix.threshold("a.md", ix.postings(vector), 2)
    assert least > 0.5 and {r.path for r in ix.possible("a.md", vector, least).collect()} == {"b.md", "d.md"}
    assert {r.path for r in ix.scores("a.md", 2, 0).collect()} == {"b.md", "d.md"}
    assert ix.possible("a.md", vector, 0.0).count() == 202
    assert [r.path for r in ix.related("a.md", 2).collect()] == [r.path for r in search.related(notes, "a.md", 2).collect()] == ["b.md", "d.md"]


def test_candidates_equal_the_scan(spark, table, index):
    texts = derived.table(spark, DATA, "benchmark").select(F.col("item_id").alias("id"), "text")
    assert sorted(map(tuple, index.candidates(texts).collect())) == sorted(map(tuple, search.link_candidates(table, texts).collect()))


def test_only_the_terms_buckets_are_opened(index):
    vector = index.vector("none.md")
    assert vector == [] and index.related("none.md").count() == 0
    plan = index.postings([r for r in index.vector(index.read("forward").first().path)][:1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_opened_again(spark, index):
    again = TermIndex(spark, index.folder)
    path = again.read("forward").first().path
    assert [tuple(r) for r in again.related(path).collect()] == [tuple(r) for r in index.related(path).collect()]


def test_index_is_no_larger_than_a_few_bytes_a_posting(spark, tmp_path):
    """A posting held its note's path and its impact, and so did the note's own row."""
    notes = spark.createDataFrame([(f"some/folder/note {i}.md", " ".join(f"word{i * j * j % 1997}" for j in range(400))) for i in range(400)], "path string, content string")
    ix = TermIndex.build(notes, str(tmp_path / "ix"))
    postings = sum(r.df for r in ix.read("terms").collect())
    held = sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet"))
    assert held < 8 * postings
    assert [tuple(r) for r in ix.related("some/folder/note 7.md").collect()] == [tuple(r) for r in search.related(notes, "some/folder/note 7.md").collect()]


def test_rows_of_one_path_are_one_note(spark, tmp_path):
    rows = [("a.md", "zebra quagga okapi [[b]]"), ("b.md", "zebra zebra lemur"), ("b.md", "quagga okapi tapir tapir zebra"), ("c.md", "okapi lemur"), ("d.md", "")]
    notes = spark.createDataFrame(rows, "path string, content string")
    ix = TermIndex.build(notes, str(tmp_path / "ix"), block=2)
    assert [tuple(r) for r in ix.related("a.md").collect()] == [tuple(r) for r in search.related(notes, "a.md").collect()]
    assert [r.path for r in ix.related("a.md").collect()] == ["b.md", "c.md"] and TermIndex(spark, ix.folder).read("forward").count() == 4
    texts = spark.createDataFrame([(1, "lemur tapir zebra")], "id int, text string")
    assert sorted(map(tuple, ix.candidates(texts).collect())) == sorted(map(tuple, search.link_candidates(notes, texts).collect()))


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_blocks_do_not_depend_on_what_is_held_at_once(monkeypatch, size):
    made = random.Random(3)
    rows = []
    for term, chunks in (("a", 1), ("b", 4), ("c", 2), ("d", 1)):
        for k in range(chunks):
            at = sorted(made.sample(range(50), made.randint(1, 9)))
            n = [made.randint(0, 3) for _ in at]
            rows.append({"bucket": 1, "term": term, "span": 0, "first": 100 * k, "at": at, "n": n, "level": [made.randint(0, 9) if x else 127 for x in n], "word": [1] * len(at)})
    kinds = pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("span", pa.int64()), ("first", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("level", pa.list_(pa.int8())), ("word", pa.list_(pa.int32()))])
    monkeypatch.setattr(termlists, "SUMS", size)
    batches = pa.Table.from_pylist(rows, schema=kinds).to_batches(max_chunksize=2)
    got = pa.Table.from_batches(termlists._laid(iter(batches), 3)).to_pylist()
    for term in "abcd":
        mine = [r for r in rows if r["term"] == term]
        want = sorted((level, r["first"] + i, n) for r in mine for i, level, n in zip(r["at"], r["level"], r["n"], strict=True))
        blocks = [b for b in got if b["term"] == term]
        assert [b["block"] for b in blocks] == list(range(-(-len(want) // 3)))
        assert [x for b in blocks for x in zip(b["ids"], b["n"], strict=True)] == [x[1:] for x in want]
        assert {b["df"] for b in blocks} == {sum(n > 0 for _, _, n in want)}
        assert all(b["best"] >= 2 ** (-want[3 * b["block"]][0] / 8) for b in blocks)
