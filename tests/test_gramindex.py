"""The stored gram index against the scan it stands for, and what patterns need."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkspark.functions.patterns import needed
from inkspark.operators import search
from inkspark.operators.gramindex import GramIndex, grams
from inkspark.sources import derived

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return derived.notes(spark, DATA).select("path", "content").cache()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    """Small chunks, pieces and buckets, so that all tables are laid out as large ones are."""
    return GramIndex.build(table, str(tmp_path_factory.mktemp("grams") / "ix"), chunk=16, piece=500, per_bucket=20000)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("abc", [{"abc"}]),
        ("ab+c", [{"ab", "c"}]),
        ("abx?cd", [{"ab", "cd"}]),
        ("ab(cd|ef)+gh", [{"ab", "cd", "gh"}, {"ab", "ef", "gh"}]),
        ("ab(cd)*gh", [{"ab", "gh"}]),
        ("ab(cd){0,2}gh", [{"ab", "gh"}]),
        (r"one\.two\d+three", [{"one.two", "three"}]),
        ("one|two", [{"one"}, {"two"}]),
        ("one|", [{"one"}, set()]),
        ("[abc]word[^x]", [{"word"}]),
        ("foo(?=bar)(?!no)", [{"foo"}]),
        ("(?i)straße", [{"stra", "e"}]),
        ("(?<n>cat)s", [{"cat", "s"}]),
        (r"\Qa.b\E", [set()]),
        ("(?x)a b", [set()]),
        ("[a[b]]cat", [set()]),
        (r"(a)\1cat", [set()]),
        ("a{2}b", [{"a", "b"}]),
        (r"\p{L}+ing", [{"ing"}]),
    ],
)
def test_needed(pattern, want):
    assert sorted(map(sorted, needed(pattern))) == sorted(map(sorted, want))


PIECES = st.recursive(
    st.sampled_from(["a", "b", "ab", "abc", "cab", ".", "[ab]", "[^c]", r"\w", "^", "$"]),
    lambda inner: st.one_of(
        st.tuples(inner, st.sampled_from(["*", "+", "?", "{2}", "{0,1}", "+?"])).map(lambda t: f"(?:{t[0]}){t[1]}"),
        st.tuples(inner, inner).map("".join),
        st.tuples(inner, inner).map(lambda t: f"({t[0]}|{t[1]})"),
        inner.map(lambda x: f"(?={x})"),
    ),
    max_leaves=8,
)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.text("abc", max_size=12))
def test_what_is_needed_is_there(pattern, text):
    """No text that a pattern matches lacks all its alternatives (the signs used here mean the same in both languages)."""
    if re.search(pattern, text):
        assert any(all(run in text for run in alternative) for alternative in needed(pattern))


@pytest.mark.parametrize("text", ["LICENSE", "Doc 17", "re:[A-Z]{4,}!!", "/license|Missing 3/i", "re:see Doc \\d+ today", "source:: src1", "ab", "re:.", "re:(", " ", "no such words anywhere", "re:zzqq|license"])
def test_search_equals_the_scan(table, index, text):
    assert rows(index.search(text)) == rows(search.search(table, text))


def test_random_literals_and_patterns_equal_the_scan(table, index):
    chance = random.Random(3)
    texts = [r.content for r in table.where(F.length("content") > 200).orderBy("path").limit(30).collect()]
    for _ in range(3):
        text = chance.choice(texts)
        at = chance.randrange(len(text) - 12)
        piece = text[at : at + chance.randrange(4, 12)]
        for sought in (piece.strip() or "see", "re:" + re.sub(r"([^\w\s])", r"\\\1", piece[:3]) + ".*" + re.sub(r"([^\w\s])", r"\\\1", piece[3:])):
            assert rows(index.search(sought)) == rows(search.search(table, sought))


def test_a_rare_word_reads_few_notes(spark, table, tmp_path):
    rare = spark.createDataFrame([("x/rare.md", "one Zyzzyva here"), ("x/long.md", "word " * 40000 + "zyzzyvas at the end")], "path string, content string")
    index = GramIndex.build(table.unionByName(rare), str(tmp_path / "ix"), chunk=64)
    found = index.looked_at("zyzzyva")
    assert sorted(r.path for r in found.collect()) == ["x/long.md", "x/rare.md"] and index.notes > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "shelf" in plan.split("PartitionFilters")[1][:80] and "In(id" in plan.split("PushedFilters")[1][:80]
    assert rows(index.search("/ZYZZYVA\\b/i")) == rows(search.search(table.unionByName(rare), "/ZYZZYVA\\b/i"))


def test_many_found_are_joined(index, table, monkeypatch):
    monkeypatch.setattr("inkspark.operators.gramindex.FEW", 3)
    assert rows(index.search("source")) == rows(search.search(table, "source"))


def test_letters_of_any_case_and_awkward_rows(spark, tmp_path):
    """Long s, Kelvin sign, dotless and dotted i, sigma at a word's end, sharp s; null and empty texts, repeated and clashing rows."""
    data = [("a.md", "the ſimple Kelvin"), ("b.md", "İstanbul nıce"), ("c.md", "ΟΔΟΣ οδός"), ("d.md", "STRAẞE Straße"), ("null words.md", None), ("e.md", ""), ("a.md", "the simple one"), ("f.md", "\U0001f600\U0001f601\U0001f602 faces")]
    notes = spark.createDataFrame([(p, t, 1, p) for p, t in data], "path string, content string, id int, shelf string")
    index = GramIndex.build(notes, str(tmp_path / "ix"), chunk=2, piece=3)
    for sought in ("/simple/i", "/kelvin/i", "/istanbul/i", "/nice/i", "/οδοσ/i", "οδοσ", "/straße/i", "straße", "null", "\U0001f601\U0001f602 faces", "re:\U0001f600.\U0001f602", "the simple"):
        assert rows(index.search(sought)) == rows(search.search(notes, sought)), sought


def test_no_notes(spark, tmp_path):
    none = spark.createDataFrame([], "path string, content string")
    index = GramIndex.build(none, str(tmp_path / "ix"))
    assert index.search("anything").count() == index.search("re:.").count() == 0
    assert GramIndex(spark, index.folder).notes == 0


def test_grams(spark):
    got = spark.createDataFrame([("abcab\ncab",), ("ab",), ("",)], "t string").select(grams("t").alias("g")).collect()
    assert [r.g for r in got] == [["abc", "bca", "cab", "ab\n", "b\nc", "\nca"], [], []]
