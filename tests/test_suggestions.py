"""Closest names against measuring every pair."""

import random
from collections import Counter

import pytest

from inkspark.operators.search import suggestions


def dice(a: str, b: str) -> float:
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a.lower(), b.lower()))
    return round(2 * (x & y).total() / (x.total() + y.total()), 6) if x and y else 0.0


@pytest.mark.parametrize("seed, letters, limit, least", [(1, "ab", 3, 0.3), (2, "abcd", 3, 0.3), (3, "abcdefgh", 1, 0.5), (4, "abcé ", 8, 0.0), (5, "aA", 2, 0.95)])
def test_equals_all_pairs(spark, seed, letters, limit, least):
    chance = random.Random(seed)
    word = lambda: "".join(chance.choices(letters, k=chance.choice([0, 1, 2, 3, 5, 8, 13, 21])))
    names, targets = [word() for _ in range(60)], [word() for _ in range(25)]
    targets += [n[:-1] for n in names[:5]] + names[:3]
    got = suggestions(spark.createDataFrame([(t,) for t in targets], "target string"), spark.createDataFrame([(n,) for n in names], "name string"), limit, least)
    want = set()
    for t in set(targets):
        best = sorted((-s, n) for n in set(names) if (s := dice(t, n)) > least)[:limit]
        want |= {(t, n, -s, i + 1) for i, (s, n) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want


def test_awkward_rows(spark):
    """Nulls, empty and very long texts, no names, no targets."""
    long = "xy z" * 5000
    targets = spark.createDataFrame([(None,), ("",), (long,), ("Note",)], "target string")
    names = spark.createDataFrame([(None, 1), (long + "!", 2), ("notes", 3), ("", 4)], "name string, df int")
    assert {(r.target[:4], r.name[:4]) for r in suggestions(targets, names).collect()} == {("xy z", "xy z"), ("Note", "note")}
    assert suggestions(targets.where("false"), names).count() == suggestions(targets, names.where("false")).count() == 0
