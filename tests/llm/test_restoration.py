"""Restoration of long and of spaced-out disguised spans."""

import itertools
import time

import numpy as np
import pytest

from inkspark.llm import toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def restore(spark):
    return toxicity.Restorer(toxicity.log_model(toxicity.letter_counts(spark.read.parquet(f"{DATA}/documents.parquet"))))


def test_long_spans(restore):
    assert restore("stu" + "u" * 40 + "pid") == "stupid"
    assert restore("stu" + "u" * 4000 + "pid") == "stupid"
    chained = restore("1d10t!l0ser|tr@sh+m0ron*l0ser|tr@sh|1d10t|st*pid")
    assert all(word in chained for word in ("idiot", "loser", "trash", "moron", "stupid"))
    assert len(restore("a1b0" * 20_000)) <= 80_000


def test_numpy_step_equals_plain(restore, monkeypatch):
    spans = ["s**p*d", "a***b***c***d", "m*r*n1*i*0t**x"]
    got = [restore.decode(x) for x in spans]
    monkeypatch.setattr(toxicity.Restorer, "MANY", 10**9)
    assert [restore.decode(x) for x in spans] == got


def test_spaced_phrases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    restore = toxicity.Restorer(toxicity.log_model(toxicity.letter_counts(docs)), toxicity.word_costs(docs))
    for phrase in ("y o u s t u p i d", "y.o.u s.t.u.p.i.d", "s t u u u u p i d m o r o n", "y o u a r e a n i d i o t", "t h a t i s t r a s h a n d h e i s a l 0 s e r"):
        words = set(restore(phrase).split())
        assert words & {"stupid", "moron", "idiot", "trash", "loser"}, words
    assert restore("s t u p i d  m o r o n") == restore("s.t.u.p.i.d m.o.r.o.n") == "stupid moron"
    assert restore("s t u p i d") == "stupid" and restore("s  t  u  p  i  d") == "stupid"


def test_word_costs(spark):
    docs = spark.createDataFrame([("Ab ab, ab cd",), ("cd x1y",), (None,)], "text string")
    names, costs = toxicity.word_costs(docs)
    shares = sorted(round(float(x), 6) for x in np.exp(-costs))
    assert shares == [0.142857, 0.142857, 0.285714, 0.428571] and list(names) == sorted(names)
    assert len(toxicity.word_costs(docs, most=3)[0]) == 2  # x and y are equally frequent


def test_long_runs_are_linear(restore):
    """Letters without a break, with and without a run; spans of many kinds in one text."""
    began = time.perf_counter()
    assert restore("ab" * 100_000) == "ab" * 100_000
    assert restore("abc" * 50_000 + "uuuu") != ""
    assert restore("a b " * 1_000 + "1 " * 1_000) != ""
    assert time.perf_counter() - began < 60


def test_viterbi_equals_all_paths(restore):
    """The decoded text of short spans is the cheapest of all that the lattice allows."""

    def cost(pieces):
        a = b = toxicity.EDGE
        total = sum(c for _, c in pieces)
        for ch in "".join(p for p, _ in pieces).encode():
            s = int(toxicity._SYMBOL[ch])
            total += float(restore.costs[a, b, s])
            a, b = b, s
        return total

    for span in ("1d10t", "l0s3r", "$cum", "tr@sh", "stuuupid", "s t u p", "m.0.r.0.n", "a1!b", "x*y"):
        paths = itertools.product(*restore.lattice(span), [(" ", 0.0)])
        best = min(paths, key=cost)
        assert cost(best) == pytest.approx(min(cost(p) for p in itertools.product(*restore.lattice(span), [(" ", 0.0)]) if "".join(x for x, _ in p).rstrip() == restore.decode(span)), abs=1e-4)
