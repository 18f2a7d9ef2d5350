"""Near duplicates and the complete join against brute force."""

import random
import re

import pytest

from inkspark.llm import jaccard
from inkspark.llm.links import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.add(frozenset((sets[i], sets[j])))
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)], {x for x in links if len(x) == 2}


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size in (12, 30, 60, 120, 400):
        for _ in range(4):
            base = rng.choices(vocabulary, k=size)
            texts += [" ".join(base)] * 3
            for _ in range(12):
                copy = list(base)
                for _ in range(rng.randint(1, max(1, size // 30))):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                texts.append("  ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy))
    passage = rng.choices(vocabulary, k=60)
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(5, 80))) for _ in range(40)]
    texts += [None, "", " \n", "one", "One", "one two three four", "one two three four five", "x " * 500, "x " * 900]
    rng.shuffle(texts)
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(5000, "one"), (5000, "one"), (None, "one two three four"), (None, "alone in the world with no id")]


@pytest.mark.parametrize("percent", [80])
def test_near_duplicates(spark, percent):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    got = [tuple(r) for r in jaccard.near_duplicates(docs, percent).select("doc_id", "n_shingles", "component_id").collect()]
    want, _ = brute(rows, percent)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_complete_join(spark):
    rows = [r for r in corpus() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard.shingle_sets(docs, 80, 5, heads=False).where("n > 0").select("k", "n", "grams").dropDuplicates(["k"])
    links = jaccard.class_links(jaccard._ordered(sets, 80), 80, spanning=False).collect()
    _, want = brute(rows)
    assert len(links) == len({frozenset((r.a, r.b)) for r in links}) == len(want)


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 200: 0, 100: 100, 101: 100}
