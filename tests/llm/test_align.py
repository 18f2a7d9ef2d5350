"""Alignment against token spans compared one by one, and counts against counters."""

from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkspark.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIDES = align.Sides(A, B, public_tokenizers.PATTERN)
ODD = ["", "a", "▁x", "y▁", "<|endoftext|> hi", "\x00a", "  x\n\n y", "日本語 emoji 😀👩‍👩‍👧", "</s> <s> <unk> <0x41>", "a" * 3000, "é́ ß ſ", "   x", " lead", "trail ", "\n"]


def spans(ids, table):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(table[i])))
        at = out[-1][1]
    return out


def brute(text, kind):
    """(n_a, n_b, n_groups, n_links, groups, counter of id pairs), from both libraries' plain encoding."""
    whole = (" " + (text or "")).encode()
    a, b = SIDES.slow.encode(" " + (text or ""), add_special_tokens=False).ids, SIDES.b.encode(text or "")
    if not text or b"".join(SIDES.bytes_a[i] for i in a) != whole or b"".join(SIDES.bytes_b[i] for i in b) != whole:
        return 0, 0, 0, 0, "", Counter()
    sa, sb = spans(a, SIDES.bytes_a), spans(b, SIDES.bytes_b)
    groups, linked, low = [], [], 0
    for end in sorted({e for _, e in sa} & {e for _, e in sb}):
        ga, gb = ([k for k, (x, y) in enumerate(s) if low <= x and y <= end] for s in (sa, sb))
        groups.append(",".join(str(a[k]) for k in ga) + "|" + ",".join(str(b[k]) for k in gb))
        for i in ga:
            for j in gb:
                if kind == "group" or (kind == "end" and sa[i][1] == sb[j][1]) or (kind == "overlap" and sa[i][0] < sb[j][1] and sb[j][0] < sa[i][1]):
                    linked.append((a[i], b[j]))
        low = end
    return len(a), len(b), len(groups), len(linked), ";".join(groups), Counter(linked)


def check(texts, kind):
    for text, row in zip(texts, align._aligned(SIDES, kind, texts), strict=True):
        want = brute(text, kind)
        assert (*row[:4], row[4].decode()) == want[:5], text
        assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(row[5].tolist(), row[6].tolist())} == dict(want[5])


@pytest.mark.parametrize("kind", align.KINDS)
def test_odd_texts(kind):
    check(ODD, kind)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6), st.sampled_from(align.KINDS))
def test_random_texts(texts, kind):
    check(texts, kind)


def corpus_brute(rows, kind):
    each = [(d, brute(t, kind)) for d, t in rows]
    counts = sum((r[5] for _, r in each), Counter())
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(
        ((d, *r[:4], sum(n for p, n in r[5].items() if counts[p] == most[p[1]]), sum(n * counts[p] for p, n in r[5].items()), sha256(r[4].encode()).hexdigest() if r[0] else "") for d, r in each), key=str
    )


@pytest.mark.parametrize("kind,limit", [("end", align.MAX_PAIRS), ("end", 0), ("overlap", 0), ("group", align.MAX_PAIRS)])
def test_corpus(spark, kind, limit):
    """Both ways of looking counts up; null ids and texts, repeated rows, clashing columns."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "no id"), (9001, None), (9002, ""), (9003, "same text"), (9003, "same text")] + [(9100 + i, t) for i, t in enumerate(ODD)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_a", "pairs", "times", "best", "pair", "groups")})
    found = align.alignment(table, A, B, public_tokenizers.PATTERN, kind, max_pairs=limit)
    got = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == corpus_brute(rows, kind)


def test_groups_and_empty(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    row = align.aligned(docs, A, B, public_tokenizers.PATTERN, with_groups=True).first()
    assert row.groups == brute("hello world", "end")[4]
    assert align.alignment(docs.where("false"), A, B, public_tokenizers.PATTERN).count() == 0


def test_pairs_that_end_together_are_few():
    """One of two tokens that end together is a suffix of the other: the bound that the broadcast rests on."""
    bound = 2 * (sum(map(len, SIDES.bytes_a)) + sum(map(len, SIDES.bytes_b)))
    assert bound < align.MAX_PAIRS


def test_very_long_text(spark):
    text = "The quick brown fox. " * 60_000
    got = align.alignment(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B, public_tokenizers.PATTERN).first()
    assert got.n_groups == got.n_links > 60_000 and got.n_a >= got.n_groups
