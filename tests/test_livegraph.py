"""The kept graph against a full computation after every batch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from inkspark.operators import graph
from inkspark.streaming.livegraph import LiveGraph, keep_graph

SCHEMA = "path string, content string, modified long"
BATCHES = int(os.environ.get("INKSPARK_BATCHES", "8"))


def same(live: LiveGraph, notes) -> None:
    every = lambda frame: sorted(tuple(map(str, r)) for r in frame.collect())
    assert every(live.edges().select("source", "target", "n")) == every(graph.edges(notes).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")))
    assert every(live.nodes()) == every(graph.nodes(notes))


def test_random_batches(spark, tmp_path):
    """Notes come, change, go and share names; links differ in case, lead to their own note, to hubs and to nothing."""
    chance, current = random.Random(11), {}
    live = LiveGraph(spark, str(tmp_path / "g"), buckets=4, every=3)
    stems = [f"N{i}" for i in range(9)]
    for turn in range(BATCHES):
        batch = []
        for _ in range(chance.randrange(1, 7)):
            path = f"{chance.choice('ab')}/{chance.choice(stems)}.md"
            links = [f"[[{chance.choice((str.upper, str.lower))(chance.choice([*stems, 'Gone', 'Ghost']))}]]" for _ in range(chance.randrange(4))]
            front = "---\nauthor: ai\nai_client: pen\n---\n" if chance.random() < 0.3 else ""
            text = None if chance.random() < 0.25 else f"{front}# T{chance.randrange(5)}\n" + " ".join(links)
            batch.append((path, text, turn * 100 + len(batch)))
        current |= {p: t for p, t, _ in batch}
        live = LiveGraph(spark, live.folder, buckets=4, every=3).apply(spark.createDataFrame(batch, SCHEMA))
        if turn % 4 != 1:
            same(live, spark.createDataFrame([(p, t, 0) for p, t in current.items() if t is not None], SCHEMA))


def test_a_new_note_takes_over_the_links_of_a_ghost(spark, tmp_path):
    live = LiveGraph(spark, str(tmp_path / "g"), buckets=2)
    put = lambda *rows: live.apply(spark.createDataFrame([(p, t, 1) for p, t in rows], SCHEMA))
    put(("a.md", "[[B]] [[b]]"), ("c.md", "# A first\n[[b]]"))
    assert [tuple(r) for r in live.ghosts().collect()] == [("missing:b", "B")]
    put(("x/B.md", "[[a]]"))
    assert live.ghosts().count() == 0 and {tuple(r) for r in live.edges().collect()} == {("a.md", "x/B.md", 2), ("c.md", "x/B.md", 1), ("x/B.md", "a.md", 1)}
    put(("x/B.md", None), ("a.md", None), ("never.md", None))
    assert {tuple(r) for r in live.nodes().select("path", "title", "degree").collect()} == {("c.md", "A first", 1), ("missing:b", "b", 1)}


def test_a_batch_that_runs_again(spark, tmp_path):
    """The tables of a batch that was cut short are written again and nothing counts twice."""
    live = LiveGraph(spark, str(tmp_path / "g"), buckets=2)
    first = spark.createDataFrame([("a.md", "[[b]]", 1), (None, "[[b]]", 1)], SCHEMA)
    second = spark.createDataFrame([("a.md", "[[c]] [[a]]", 2), ("a.md", "[[z]]", 1), ("b.md", "", 2)], SCHEMA)
    live.apply(first)
    for _ in range(2):
        LiveGraph(spark, live.folder, 2).apply(second, 1)
    same(LiveGraph(spark, live.folder, 2), spark.createDataFrame([("a.md", "[[c]] [[a]]", 2), ("b.md", "", 2)], SCHEMA))


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "[[b]]", 1), ("b.md", "[[a]] [[nothing]]", 1)], SCHEMA)
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep_graph(stream, str(tmp_path / "g"), str(tmp_path / "c"), buckets=2).awaitTermination()
    same(LiveGraph(spark, str(tmp_path / "g"), 2), rows)


def test_nothing(spark, tmp_path):
    live = LiveGraph(spark, str(tmp_path / "g"))
    assert live.nodes().count() == live.edges().count() == 0
    live.apply(spark.createDataFrame([], SCHEMA))
    assert live.nodes().count() == 0 and live.last == 0


@pytest.mark.parametrize("keys", [["b"], ["b", "zz"]])
def test_only_folders_of_the_keys_are_read(spark, tmp_path, keys):
    live = LiveGraph(spark, str(tmp_path / "g"), buckets=16)
    live.apply(spark.createDataFrame([(f"n{i}.md", "[[b]] [[c]]", 1) for i in range(9)], SCHEMA))
    found = live.rows("into", spark.createDataFrame([(k,) for k in keys], "name string"))
    assert found.count() == 9
    assert "bucket" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]
