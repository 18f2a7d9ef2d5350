"""Lists of words by note and by term, and what related notes leave on the disk."""

import math
import os
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkspark.functions import markdown as md
from inkspark.lineage import scratch, shared_dir
from inkspark.operators import graph, search, termlists

ODD = [
    ("a/x_y.md", "# The Öl_Test\nsnake_case snake_case ΑΣ_ΒΣ İstanbul öl öl with WITH and und 12 123 [[b]] [[none]]"),
    ("b.md", "snake case ΑΣ öl_ __ _ab_ test test123 [[x_y|so]] [[B]]"),
    ("c.md", ""),
    ("d.md", None),
    ("e.md", "the of in and"),
    ("f/b.md", "---\ntitle: no\n---\n# {{title}}\nzebra zebra zebra"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "path string, content string")


def test_bags_hold_terms_and_significant_words(spark, odd):
    folder, total = termlists.bags(odd, scratch(spark, "bags"))
    held = spark.read.parquet(folder)
    got = {r.path: r.bag for r in held.collect()}
    whole = F.concat(md.title("path", "content"), F.lit(" "), F.col("content"))
    want = odd.select("path", md.terms("content").alias("terms"), md.significant_terms(whole).alias("words")).collect()
    assert total == len(got) == len(ODD)
    for r in want:
        assert {e.term: e.n for e in got[r.path] if e.n} == Counter(r.terms or [])
        assert {e.term for e in got[r.path] if e.word} == set(r.words or [])
    rows = lambda t: sorted(map(str, t.select("src", "target", "name", "dst").collect()))
    assert rows(termlists.resolved(held)) == rows(graph.resolved(odd))


def brute(notes, path, limit):
    """What the SQL says: rows of one path are one note, but all rows count as notes."""
    counts = defaultdict(Counter)
    for p, words in notes:
        counts[p].update(words)
    df = Counter(t for c in counts.values() for t in c)
    w = {p: {t: n * (math.log(len(notes) / df[t]) + 1) for t, n in c.items()} for p, c in counts.items()}
    norm = {p: math.sqrt(sum(x * x for x in v.values())) for p, v in w.items()}
    dots = {p: sum(x * w[path].get(t, 0) for t, x in v.items()) for p, v in w.items() if p != path}
    return sorted(((-round(d / norm[p] / norm[path], 6), p) for p, d in dots.items() if d > 0))[:limit]


def test_rows_of_one_path_are_one_note(spark):
    rows = [("a.md", "zebra quagga okapi"), ("b.md", "zebra zebra lemur"), ("b.md", "quagga okapi tapir tapir zebra"), ("c.md", "okapi lemur"), ("d.md", "gnu")]
    frame = spark.createDataFrame(rows, "path string, content string")
    got = [(-r.score, r.path) for r in search.related(frame, "a.md").collect()]
    assert got == brute([(p, t.split()) for p, t in rows], "a.md", 8)


def test_related_leaves_nothing_on_disk(spark):
    """The counts of every word of every note stayed as a checkpoint, unpacked."""

    def held() -> int:
        top = shared_dir(spark).removeprefix("file:")
        return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)

    notes = spark.createDataFrame([(f"{i}.md", " ".join(f"word{i * j % 997}" for j in range(200))) for i in range(300)], "path string, content string")
    before = held()
    assert search.related(notes, "7.md").count() == 8
    assert held() == before


def test_lists_of_any_size_give_the_same_sums(monkeypatch):
    bag = pa.array([[{"term": f"t{(i * k) % 7}", "n": k + 1, "word": True} for k in range(1 + i % 3)] for i in range(20)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 120), pa.int64()), bag], ["id", "bag"])

    def summed():
        lists = pa.Table.from_batches(termlists._turned(iter([batch]), False)).to_pylist()
        df, found = Counter(), defaultdict(lambda: [0.0, 0.0])
        for r in lists:
            df[r["term"]] += len(r["at"])
        table = pa.Table.from_pylist([r | {"df": df[r["term"]], "own": int(r["term"] == "t1")} for r in lists])
        for r in pa.Table.from_batches(termlists._summed(iter(table.to_batches()), 20)).to_pylist():
            found[r["id"]][0] += r["squares"]
            found[r["id"]][1] += r["dot"]
        return len(lists), {k: [round(x, 9) for x in v] for k, v in found.items()}

    few, want = summed()
    for name in ("CHUNK", "SUMS"):
        monkeypatch.setattr(termlists, name, 3)
    many, got = summed()
    assert many > few and got == want and len(got) == 20
