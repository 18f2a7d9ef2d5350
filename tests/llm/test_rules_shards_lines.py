"""Quality rules, sharding and line dedup against brute force, with awkward rows."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.llm import linedup, rules, shards

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(again)


AWKWARD = [None, "", " \n\t", "a", "a b", "a b a b a b", "x y z\nx y z\n\nx y z", "é ö|#\x0b\x0cß 😀 a", " a b  c", "ab c ab c d", " lead\r\nlead\r\n"]


def test_counts(spark):
    texts = AWKWARD + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in rules.STATS) for r in rules.with_counts(frame).select("doc_id", *rules.STATS).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_judge(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("kept", F.lit("clash"))
    rows = rules.judge(docs).collect()
    assert len(rows) == docs.count() and rows[0].text is not None
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean(good) > 0.97
    signs = [r.kept for r in rows if r.n_symbols > r.n_words and not r.base_failed]
    assert signs and not any(signs)


def test_judge_empty_and_null(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert rules.judge(spark.createDataFrame([], schema)).count() == 0
    rows = rules.judge(spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "word " * 60, "en", None)], schema)).collect()
    assert [r.kept for r in rows] == [False] * 3
    long = " ".join(f"w{i}" for i in range(60))
    assert rules.judge(spark.createDataFrame([(1, long, None, None)], schema)).first().kept


def test_long_texts(spark):
    """A million words, and a line that is repeated as often; windows are compared by their words."""
    rng = np.random.default_rng(4)
    million = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 1_000_000)) + " a b c d a b c"
    rows = {1: million, 2: "again and again\n" * 50_000}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in rules.STATS) for r in rules.with_counts(frame).select("doc_id", *rules.STATS).collect()}
    assert got == {i: counts(t) for i, t in rows.items()} and got[1][4] >= 6


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """With a hash that says nothing, the counts stay exact."""
    monkeypatch.setattr(rules.F, "xxhash64", lambda *x: F.lit(-1).cast("long"))
    texts = AWKWARD + ["a b c d e f g a b c", "x x x x y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in rules.with_counts(frame).select("doc_id", "n_repeat_words").collect()}
    assert got == {i: counts(t)[4] for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", [1, 7, 40])
def test_shards(spark, n):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", F.lit(1).alias("size"))
    hot = docs.limit(1).withColumn("text", F.lit("same words")).drop("doc_id", "size")
    docs = docs.unionByName(hot.crossJoin(spark.range(5000, 5150)).selectExpr("id AS doc_id", "text", "1 AS size"))
    rows = shards.shard_documents(docs, n).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    size = Counter()
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r.size
    largest = max(r.size for r in rows)
    assert all(abs(size[s] - sum(size.values()) / n) <= 0.011 * sum(size.values()) / n + largest for s in range(n))
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.shard for r in rows if 5000 <= r.doc_id}) <= 2  # equal texts lie side by side


def test_groups_of_equal_texts_that_fit_a_shard_are_not_parted(spark):
    """Pairs and small groups stand whole beside every border; one of a third of all rows is cut, and shards stay near equal."""
    pairs = [(i, f"pair {i // 2} " + "x" * (40 + i // 2 * 7 % 300)) for i in range(600)]
    tens = [(1000 + i, f"ten {i // 10}") for i in range(400)]
    docs = spark.createDataFrame(pairs + tens + [(2000 + i, "hot " + "h" * 150) for i in range(500)], "doc_id long, text string")
    rows = shards.shard_documents(docs, 40).join(docs, "doc_id")
    held = {r.text: (r.n, r.in_shards) for r in rows.groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("in_shards")).collect()}
    mean = sum(len(t) + 16 for t in [r.text for r in docs.collect()]) / 40
    parted = [t for t, (n, k) in held.items() if k > 1]
    assert all(held[t][0] > 2 and held[t][0] * (len(t) + 16) > 0.02 * mean for t in parted) and not [t for t in parted if t.startswith("pair")]
    assert held["hot " + "h" * 150][1] > 5
    sizes = [r.b for r in rows.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 40 and max(abs(b - mean) for b in sizes) <= 2 * 366
    whole = shards.shard_documents(docs, 4, together=0.5).join(docs, "doc_id").where("text NOT LIKE 'hot%'")
    assert whole.groupBy("text").agg(F.countDistinct("shard").alias("k")).where("k > 1").count() == 0


def test_shards_awkward(spark):
    schema = "doc_id long, text string, shard int"
    assert shards.shard_documents(spark.createDataFrame([], schema), 4).count() == 0
    rows = shards.shard_documents(spark.createDataFrame([(None, None, 1), (None, None, 1), (3, "", 1), (3, "x" * 100_000, 1)], schema), 4).collect()
    assert sorted(r.size for r in rows) == [16, 16, 16, 100_016]
    assert [r.text_crc32 for r in rows if r.size == 16] == [0, 0, 0]


def test_a_text_with_many_copies(spark):
    """Copies of one text are dealt to many groups when places are given out."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, NULL, concat('text ', id)) AS text", "id AS key_hi", "id AS row")
    rows = shards.shard_documents(docs, 8)
    got = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert len(got) == 8 and sum(r.n for r in got) == 20_000
    assert all(r.n == r.slots == r["last"] + 1 for r in got) and max(r.bytes for r in got) < 1.01 * min(r.bytes for r in got)


def test_line_dedup_awkward(spark, monkeypatch):
    """Clashing names, repeated rows, a long text, and the shuffled join beyond the broadcast's bound."""
    wide = "a line on very many sites here"
    rows = [(i, wide + "\n" + f"own line number {i} of this text", f"s{i}", "x", "y") for i in range(30)] + [(0, wide, "s0", "x", "y")] * 2 + [(99, (wide + "\nother\n") * 20_000, "s1", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, line string")
    want = sorted((r.doc_id, r.text, r.n_lines, r.n_removed, r["_id"], r.line) for r in linedup.drop_spread_lines(docs).collect())
    assert len(want) == 33 and want[0][1] in ("", "own line number 0 of this text") and all(wide not in r[1] for r in want)
    assert want[-1][1] == "\n".join(["other"] * 20_000 + [""])
    monkeypatch.setattr(linedup, "MAX_BROADCAST", 0)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed, r["_id"], r.line) for r in linedup.drop_spread_lines(docs).collect()) == want


def test_line_dedup_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(linedup.ORACLE_SQL).fetchall()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linedup.drop_spread_lines(docs).collect()}
    assert got == want and sum(v[2] for v in got.values()) > 0


def test_line_dedup_thresholds(spark):
    wide, near, rare = "a line on forty sites here", "a line on ten sites, exactly", "a line on nine sites, as said"
    rows = [(i, "\n".join([f"own text of number {i}, kept", wide, *([near] if i < 10 else []), *([rare] if i < 9 else []), "short"]), f"s{i}") for i in range(40)]
    rows += [(100, None, "s0"), (100, "", None), (None, wide + "\r\n  " + wide, None)]
    out = {(r.doc_id, r.source): r for r in linedup.drop_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0, "s0"].text == f"own text of number 0, kept\n{rare}\nshort" and out[0, "s0"].n_removed == 2
    assert out[20, "s20"].text == "own text of number 20, kept\nshort"
    assert out[100, "s0"].text is None and out[100, None].text == "" and out[None, None].text == "" and out[None, None].n_removed == 2
    assert linedup.drop_spread_lines(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
