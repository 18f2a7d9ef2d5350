"""Scores against plain recomputation, and awkward rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkspark.llm import quality, toxicity
from inkspark.llm._text import words

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def test_context_vectors(spark):
    """Sums over all documents, by hand; texts do not reach into each other."""
    texts = ["Red fox runs far", "fox RED", None, "", "one", "red fox"]
    got = quality.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    sums = {}
    for t in texts:
        column = pa.array([t], pa.string())
        pairs = [quality.forms(w) for w in words(column)]
        plain, shapes = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, int) for i in (0, 1))
        for i in range(len(plain)):
            for j in range(max(0, i - 2), min(len(plain), i + 3)):
                if i != j:
                    for row in (plain[i], shapes[i]):
                        sums[row] = sums.get(row, 0) + quality._INDEX[plain[j]].astype(float) + quality._INDEX[shapes[j]]
    for row, v in sums.items():
        assert np.allclose(got[np.array([row])][0], v / max(np.linalg.norm(v), 1e-9), atol=1e-5)
    unknown = quality.forms(next(words(pa.array(["neverseen"]))))[0]
    assert not got[unknown].any()


def test_context_vectors_of_frequent_words(spark):
    """Sums beyond 127 are rounded to a step of 1/127 of the largest."""
    text = " ".join(["red fox runs"] * 3000)
    got = quality.context_vectors(spark.createDataFrame([(text,)] * 3, "text string"))
    plain, shapes = (p.astype(int) for p in quality.forms(next(words(pa.array([text])))))
    own = quality._INDEX[plain].astype(float) + quality._INDEX[shapes]
    for row in set(plain.tolist()):
        v = np.zeros(quality.DIMS)
        for i in np.flatnonzero(plain == row):
            v += own[max(0, i - 2) : i + 3].sum(0) - own[i]
        v *= 3
        assert np.abs(v).max() > 127
        assert np.abs(got[np.array([row])][0] - v / np.linalg.norm(v)).max() <= np.abs(v).max() / np.linalg.norm(v) / 254 + 1e-6


def test_quality_scores_by_hand(tables, spark):
    docs, labels = tables
    model = quality.fit(docs, labels)
    for r in quality.score(docs.limit(40), model).collect():
        column = pa.array([r.text], pa.string())
        parts = [quality.forms(w) for w in words(column)]
        x = np.zeros(quality.WIDTH)
        if parts and len(parts[0][0]):
            for k in range(2):
                rows = np.concatenate([p[k] for p in parts])
                v = model.vectors[rows].astype(float)
                x[k * quality.DIMS : (k + 1) * quality.DIMS] = v.mean(0)
                x[2 * quality.DIMS + k] = (v[1:] * v[:-1]).sum() / len(v)
            x[-1] = np.log1p(len(v))
        a, b, c, d = model.network.weights
        z = np.maximum((x - model.network.mean) / model.network.scale @ a + b, 0) @ c + d
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z / model.network.temperature + model.network.shift, -30, 30))), abs=1e-4)


def test_toxicity_scores_by_hand(tables, spark):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs.limit(40), model, restored_col="plain").collect():
        found = {}
        for word in re.findall("[a-z\x80-\U0010ffff]+", r.plain):
            raw = word.encode()
            for _, _, hashes, _ in toxicity.features([word]):
                for h in hashes.tolist():
                    found[h] = found.get(h, 0) + 1
            assert raw
        words_in = len(re.findall("[a-z\x80-\U0010ffff]+", r.plain))
        z = model.intercept + model.weights[-1] * np.log1p(words_in) + sum(w * np.log1p(found.get(int(h), 0)) for h, w in zip(model.chosen, model.weights))
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-3)


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_awkward_rows(tables, spark, kind):
    """Null ids and texts, repeated rows, a long text, clashing names, and an empty table."""
    docs, labels = tables
    model = kind.fit(docs, labels)
    long = "some words of a very long text, idiot " * 20_000
    rows = [(None, "x", "a", "b"), (1, None, "a", "b"), (2, "", "a", "b"), (3, long, "a", "b"), (3, long, "a", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string, label string")
    out = kind.score(frame, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.label == "b" for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    classified = kind.classify(frame, model).collect()
    folds, held = (4, 2) if kind is quality else (3, 1)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in classified)
    assert kind.classify(frame.where("false"), model).count() == 0
    none = kind.fit(frame.where("false").select("doc_id", "text"), labels)
    assert kind.classify(frame, none).count() == 5
