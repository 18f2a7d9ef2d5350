"""Byte-level BPE and packing against the public libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspark.llm import bpe, packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"
AWKWARD = [None, "", " ", "\n\n  x", "don't  stop  now\x1c\x1d 123 é中\U0001f600", "<|endoftext|>", "a" * 5000, "ab" * 3000, "= " * 3000]


@pytest.fixture(scope="module")
def coder():
    return bpe.load(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeinrst '0.\né", max_size=200)))
def test_same_as_library(text):
    coder = bpe.load(PATH, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    packed = coder.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert coder.decode(packed) == text.encode()


def test_digests(spark, library):
    rows = list(enumerate(AWKWARD)) + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.digests(docs, PATH, PATTERN).collect()}
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.digests(docs.where("false"), PATH, PATTERN).count() == 0


def check_packing(rows, documents, size):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sum(n for parts in bins.values() for _, n in parts) == sum(map(len, documents))
    return len(bins)


def test_packing(spark):
    tokenizer = packing._tokenizer(JSON)
    rows = list(enumerate(AWKWARD)) + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(packing.pieces(docs, JSON, PATTERN)).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == ids.keys()
    for i, parts in by.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.length for r in parts[1:]] == [2048] * (len(parts) - 1) and sum(r.length for r in parts) == len(ids[i])
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
    used = check_packing(out, ids.values(), 2048)
    assert used <= -(-sum(map(len, ids.values())) // 2048) + 1
    assert packing.pack(packing.pieces(docs.where("false"), JSON, PATTERN)).count() == 0


def test_other_vocabulary_files(spark):
    """A file of another kind goes through its own library."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = packing.Coder(path, PATTERN)
    assert coder.fast is None and coder.encode("Hello there").tolist() == packing._tokenizer(path).encode("Hello there", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_best_fit(lengths):
    bins, room = packing.Bins(50), []
    for n in sorted(lengths, reverse=True):
        fitting = [(r, i) for i, r in enumerate(room) if r >= n]
        which, offset = bins.place(n)
        if fitting:
            assert room[which] == min(fitting)[0]
        else:
            assert which == len(room)
            room.append(50)
        assert offset == 50 - room[which]
        room[which] -= n


PLAIN = [chr(i) for i in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.sampled_from(PLAIN), max_size=40), st.text(st.sampled_from(PLAIN[:128]), max_size=80)))
def test_plain_texts_are_the_same_to_both_libraries(text):
    """Over the whole of the plain characters, control characters and white space included."""
    coder = packing.coder(JSON, PATTERN)
    assert coder.encode(text).tolist() == packing._tokenizer(JSON).encode(text, add_special_tokens=False).ids


def test_every_plain_pair_of_kinds():
    """Each plain character alone, doubled, and between a letter, a digit and spaces."""
    coder, library = packing.coder(JSON, PATTERN), packing._tokenizer(JSON)
    for ch in PLAIN:
        for text in (ch, ch * 2, f"a{ch}b", f"1{ch}2", f" {ch} ", f"x  {ch}\n{ch}'s"):
            assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(ord(ch))


def test_packing_in_several_tasks(spark):
    """Null ids and repeated rows are packed apart; no task leaves more than one sequence open beyond need."""
    rows = [(i % 300 if i % 7 else None, "word " * (i * 37 % 1500), "clash", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, piece long")
    parts = packing.pieces(docs, JSON, PATTERN)
    out = packing.pack(parts, per_task=60).collect()
    total = sum(r.length for r in out)
    assert len({r.sequence_id >> 40 for r in out}) > 2
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))]
    tasks = len({s >> 40 for s in bins})
    assert total / 2048 <= len(bins) <= 1.02 * total / 2048 + tasks
    assert sum(r.doc_id is None for r in out if r.piece == 0) == sum(r[0] is None for r in rows)
