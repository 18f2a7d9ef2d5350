"""Classifiers on held-out rows, restoration, nearest neighbours, and archives."""

import base64
import gzip
import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.llm import ann, quality, toxicity, warc

DATA = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def accuracy(rows, column):
    held = [r for r in rows if r.held_out]
    return np.mean([r.predicted == r[column] for r in held]), [r for r in held]


def test_quality(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels, per_class=1500)
    rows = quality.classify(docs.join(labels.select("doc_id"), "doc_id"), model).join(labels, "doc_id").collect()
    share, held = accuracy(rows, "quality")
    assert share > 0.96 and 100 < len(held)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x"), (2, "x")], "doc_id long, text string")
    scores = [r.score for r in quality.classify(odd, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores) and scores[2] == scores[3]
    assert quality.classify(odd.where("false"), model).count() == 0


def test_labels_of_one_class(spark, labelled):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert {r.score for r in quality.classify(docs, quality.fit(docs, one)).collect()} == {1.0}
    assert all(r.score < 0.01 for r in toxicity.classify(docs, toxicity.fit(docs, one)).collect())
    assert {r.score for r in quality.classify(docs, quality.fit(docs, one.where("false"))).collect()} == {0.5}


def test_temperature_and_layers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(int)  # not separable by one layer
    net = quality.train(x, y, {0: int((y == 0).sum()), 1: int(y.sum())}, epochs=800)
    assert np.mean((net.scores(x) > 0.5) == y) > 0.9 and 0.5 <= net.temperature <= 8


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.classify(docs.join(labels.select("doc_id"), "doc_id"), model).join(labels, "doc_id").collect()
    share, held = accuracy(rows, "toxic")
    assert share > 0.97
    assert np.mean([r.predicted for r in held if r.toxic == 0]) < 0.01
    assert np.mean([r.predicted for r in held if r.toxic == 1]) > 0.85
    restore = toxicity.Restorer(model.costs)
    hidden = {"1d10t": "idiot", "l0ser": "loser", "tr@sh": "trash", "s t u p i d": "stupid", "m.o.r.o.n": "moron", "stuuuupid": "stupid", "st*pid": "stupid", "$cum": "scum"}
    assert {k: restore(k) for k in hidden} == hidden
    for plain in ("a clean text of 12 words, nothing more", "on 2024-01-01 at 12:30", "of%%% the***"):
        assert restore(plain) == plain
    base = docs.where("doc_id = 1").first().text
    texts = [(1, base), (2, base.replace(" ", " 1d10t ", 2).replace(".", " l0ser.", 2)), (3, None), (4, "")]
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model, restored_col="plain").collect()}
    assert out[2].score > 0.7 > out[1].score and "idiot" in out[2].plain and out[3].score == out[4].score


def neighbours(rows, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[ids == ids[i]] = np.inf
        best = [j for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in best]
    return out


@pytest.mark.parametrize("how", [{"per_list": 40, "probes": 24, "least": 12}, {"max_lists": 8, "split_at": 300}])
def test_nearest(spark, how):
    """Pruned lists at one level, and lists that are split again."""
    frame = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = neighbours([(r.vec_id, r.embedding) for r in frame.collect()])
    got = defaultdict(list)
    for r in ann.nearest(frame, F.col("vec_id") % 100 == 0, **how).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = np.mean([len({v for v, _ in got[q]} & {v for v, _ in w}) / len(w) for q, w in want.items()])
    assert hit >= 0.9 and all([s for _, s in v] == sorted(s for _, s in v) for v in got.values())


def test_nearest_awkward(spark):
    rows = [(i, [1.0, 0.0, float(i % 2)]) for i in range(1, 30)] + [(100, [1.0, 0.0, 0.0]), (200, None), (300, [0.0, 0.0, 0.0]), (400, [float("nan"), 1.0, 1.0]), (500, [1.0, None, 1.0]), (600, [1.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, list string")
    out = ann.nearest(frame, F.col("vec_id") % 100 == 0, block_rows=4).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in out] == [(100, i, 0.0) for i in range(2, 21, 2)]
    assert ann.nearest(frame.where("false"), F.lit(True)).count() == 0
    two = ann.nearest(frame.where("vec_id in (1, 100)"), F.lit(True)).collect()
    assert sorted((r.query_id, r.vec_id) for r in two) == [(1, 100), (100, 1)]


def test_graph_search_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    c, x = rng.normal(size=(300, 8)), rng.normal(size=(64, 8))
    ids, _ = ann.Graph.over(c).search(x, 5, 40)
    exact = np.argsort(((x[:, None] - c[None]) ** 2).sum(2), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, exact)]) > 0.95


def test_archives(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    odd = [(9001, None, None), (9002, "http://x/a b", ""), (9003, "http://x", "hi\r\n\r\nWARC/1.1\r\n"), (9004, "HTTP://www.X:80/", "hi\r\n\r\nWARC/1.1\r\n"), (9004, "http://x", "hi\r\n\r\nWARC/1.1\r\n"), (9004, "http://x", "é" * 70_000), (None, "http://x", "hi\r\n\r\nWARC/1.1\r\n"), (None, "u", "only null ids")]
    both = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    rows = warc.round_trip(both, path=str(tmp_path / "w")).collect()
    groups = defaultdict(list)
    for r in both.collect():
        groups[r.html or ""].append(r.page_id)
    want = []
    for html, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for i in ids:
            first = best is None or i == best
            want.append((i, len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode(), "response" if first else "revisit", None if first else best))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    ordered = [(r.url_key, r.captured) for r in sorted(rows, key=lambda r: (r.range, r.place))]
    assert ordered == sorted(ordered)
    assert warc.round_trip(both.where("false"), path=str(tmp_path / "e")).count() == 0
    small = warc.round_trip(both.repartition(2), path=str(tmp_path / "s"), file_bytes=5_000).collect()
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in small))) == sorted(map(str, want))
    assert len({r.archive for r in small}) > 5
    for r in small[:40]:  # a record is found again by its place
        with open(tmp_path / "s" / r.archive, "rb") as f:
            f.seek(r["at"])
            _, headers, _ = next(warc.records(f))
        assert headers["warc-payload-digest"] == f"sha1:{r.payload_digest}" and warc._page(headers["warc-record-id"]) == r.page_id
    lost = both.sparkSession.createDataFrame([(r.url_key, r.captured, r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.archive, r["at"]) for r in small if r.record_type == "revisit"], warc.CAPTURES)
    with pytest.raises(Exception, match="no response"):
        warc.checked(lost).collect()
    assert all(r.record_type == "response" for r in warc.round_trip(both, min_bytes=10**9, path=str(tmp_path / "m")).collect())


def test_reader_and_tree():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, _, b in warc.records(gzip.compress(record) + gzip.compress(record))] == [b"abc", b"abc"]
    assert [o for o, _, _ in warc.records(record * 2)] == [0, len(record)]
    for bad in (record[:-6], b"nothing\r\n\r\n", record[:-4] + b"xxxx"):
        with pytest.raises(ValueError):
            list(warc.records(bad))
    runs = [[(1,), (4,), (4,)], [], [(0,), (9,)], [(2,)]]
    assert [x[0] for x in warc.LoserTree(runs, key=lambda r: r)] == [0, 1, 2, 4, 4, 9]
    assert list(warc.LoserTree([])) == []
    assert warc.url_key("https://www.a.example.com:443/P?q#f") == "com,example,a)/p?q#f"
