"""Alignment of two tokenizers' tokens over the same text, and how often their ids meet.

Both tokenizers see a space and the text. Token ends are byte offsets; ``union``
of both end arrays cuts the bytes into elementary intervals, and a search in
each end array gives the interval's owners, so that every interval is one
overlap of a token of A and one of B. An end that both have closes a group.
Three kinds of link can be asked for: pairs that ``end`` together, pairs that
``overlap``, and ``group``: all pairs within a group, by expanding each group's
product.

A pair's count is how many links of the whole corpus hold its ids. Links are
stored per document as sorted distinct pairs with their numbers; the counts are
summed within batches, then by Spark. Of two tokens that end together one is a
suffix of the other, so their pairs are at most as many as all tokens of both
vocabularies have bytes (twice that, for byte pieces): that table is broadcast.
Tables of the other kinds are broadcast up to ``MAX_PAIRS`` rows and joined
beyond.

Defined results: a null or empty text, and one whose tokens of A or of B do not
join to a space and the text, has no tokens; special tokens' strings are plain
text; a null id is kept, and equal rows are rows of their own and count each; a
very long text is encoded whole; pairs of equal count are all best; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, store
from .packing import _PLAIN, Coder, _byte_signs

KINDS = ("end", "overlap", "group")
#: Rows up to which a table of pair counts is broadcast (16 bytes each in tasks).
MAX_PAIRS = 2_000_000
#: Bytes of text that are aligned at once, if no text is longer.
_CHUNK = 1 << 20


class Sides:
    """Both tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.fast = Coder(path_a, pattern).fast
        self.odd = regex.compile(_PLAIN).search
        self.slow = Tokenizer.from_file(path_a)
        self.slow.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in _byte_signs().items()}
        size = self.slow.get_vocab_size()
        signs = [self.slow.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for s in signs]
        pieces = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # decimal ids with the sign that follows: within a group, at the end of its A side, at the end of the group
        self.signs = np.array([f"{i}{s}".encode() for s in ",|;" for i in range(max(size, len(pieces)))], object).reshape(3, -1)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B for each text; none where they do not join to a space and the text."""
        a = [self.fast.encode_to_numpy(" " + t, disallowed_special=()) if self.fast and not self.odd(t) else self.slow.encode(" " + t, add_special_tokens=False).ids for t in texts]
        a = [np.asarray(x, np.int64) for x in a]
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]
        none = np.zeros(0, np.int64)
        for i, t in enumerate(texts):
            whole = b" " + t.encode()
            if not t or b"".join(map(self.bytes_a.__getitem__, a[i].tolist())) != whole or b"".join(map(self.bytes_b.__getitem__, b[i].tolist())) != whole:
                a[i] = b[i] = none
        return a, b


@lru_cache(maxsize=1)
def _sides(path_a: str, path_b: str, pattern: str) -> Sides:
    return Sides(path_a, path_b, pattern)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner_a, owner_b of every elementary interval, and the groups that A's and B's tokens are in.

    Ends ascend strictly and have the same last value, so texts laid end to
    end are aligned in one call.
    """
    ends = np.union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    closes = (ends_a[owner_a] == ends) & (ends_b[owner_b] == ends)
    shared = ends[closes]
    return owner_a, owner_b, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)


def links(kind: str, owner_a: np.ndarray, owner_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked occurrences as positions among A's and B's tokens, in the order of the text."""
    if kind == "overlap":
        return owner_a, owner_b
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    stop_a, stop_b = np.searchsorted(group_a, np.arange(groups), side="right"), np.searchsorted(group_b, np.arange(groups), side="right")
    if kind == "end":
        return stop_a - 1, stop_b - 1
    wide = np.diff(stop_b, prepend=0)[group_a]  # a token of A meets all of its group's B side
    first = (stop_b - np.diff(stop_b, prepend=0))[group_a]
    a = np.repeat(np.arange(len(group_a)), wide)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(first, wide)


def _aligned(sides: Sides, kind: str, texts: list[str]) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, n_links, groups as text, pairs, times) of each text."""
    ids_a, ids_b = sides.encode(texts)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(sides.length_a[a]), np.cumsum(sides.length_b[b])
    owner_a, owner_b, group_a, group_b = align(ends_a, ends_b)
    at_a, at_b = links(kind, owner_a, owner_b, group_a, group_b)
    # the groups written out: A's tokens, then B's, group by group
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(a)], np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
    written = np.empty(len(a) + len(b), object)
    written[np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")] = sides.signs[last_a * 1, a]
    written[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = sides.signs[last_b * 2, b]
    pair = a[at_a] << 32 | b[at_b]
    stop_a, stop_b = np.cumsum([len(x) for x in ids_a]), np.cumsum([len(x) for x in ids_b])
    stop_link = np.searchsorted(at_a, stop_a)
    done_a = done_b = done = 0
    for i, j, k in zip(stop_a.tolist(), stop_b.tolist(), stop_link.tolist()):
        pairs, times = np.unique(pair[done:k], return_counts=True)
        groups = int(group_a[i - 1] - group_a[done_a]) + 1 if i > done_a else 0
        yield i - done_a, j - done_b, groups, k - done, b"".join(written[done_a + done_b : i + j].tolist())[:-1], pairs, times
        done_a, done_b, done = i, j, k


def aligned(docs: DataFrame, path_a: str, path_b: str, pattern: str, kind: str = "end", id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Per document its numbers of tokens, groups and links, the groups' digest (and text, if asked for), and its links.

    Links are ``pairs`` (id of A << 32 | id of B, distinct) and ``times``, as
    little-endian 64-bit and 32-bit integers.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        sides = _sides(path_a, path_b, pattern)
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                ids, texts, size = [], [], 0
                while done < batch.num_rows and size < _CHUNK and len(ids) < 1000:
                    ids.append(batch.column(0)[done].as_py())
                    texts.append(batch.column(1)[done].as_py() or "")
                    size, done = size + len(texts[-1]), done + 1
                rows = [(d, *r[:4], sha256(r[4]).hexdigest() if r[0] else "", r[4].decode() if with_groups else None, r[5].astype("<i8").tobytes(), r[6].astype("<i4").tobytes()) for d, r in zip(ids, _aligned(sides, kind, texts))]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()] * 2)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, times binary"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _arrays(pairs, times) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<i4")


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n, best: how many links hold each pair of ids, and whether no pair of that B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def out() -> pa.RecordBatch:
            keys, n = summed()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for p, t in zip(batch.column(0), batch.column(1)):
                keys, times = _arrays(p.as_py(), t.as_py())
                if len(keys):
                    held.append((keys, times))
                    size += len(keys)
                if size > 4_000_000:
                    keys, n = summed()
                    held, size = [(keys, n)], len(keys)
                    if size > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])
                        held, size = [], 0
        if held:
            yield out()

    sums = found.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = sums.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(found: DataFrame, counts: DataFrame, broadcast: bool) -> DataFrame:
    """``found`` with n_best, links whose pair is best, and count_sum, their pairs' counts added up."""
    if not broadcast:
        unpack = F.udf(lambda p, t: list(zip(*(x.tolist() for x in _arrays(p, t)))), "array<struct<pair:long,times:int>>", useArrow=True)
        keyed = found.withColumn("_row", F.monotonically_increasing_id())
        rows = keyed.select("_row", F.explode(unpack("pairs", "times")).alias("l")).select("_row", "l.*")
        table = counts.select((F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))).alias("pair"), "n", "best")
        sums = rows.join(table, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        zero = F.lit(0).cast("long")
        return keyed.join(sums, "_row", "left").drop("_row", "pairs", "times").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
    table = counts.toArrow()
    pair = table["a"].to_numpy().astype(np.int64) << 32 | table["b"].to_numpy().astype(np.int64)
    order = np.argsort(pair)
    shared = found.sparkSession.sparkContext.broadcast((pair[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            sums = []
            for p, t in zip(batch.column("pairs"), batch.column("times")):
                pairs, times = _arrays(p.as_py(), t.as_py())
                at = np.searchsorted(keys, pairs)
                sums.append((int(best[at] @ times), int(n[at] @ times)) if len(pairs) else (0, 0))
            kept = [i for i, c in enumerate(batch.schema.names) if c not in ("pairs", "times")]
            new = [pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *new], names=[*[batch.schema.names[i] for i in kept], "n_best", "count_sum"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name not in ("pairs", "times"))
    return found.mapInArrow(run, f"{names}, n_best long, count_sum long")


def alignment(docs: DataFrame, path_a: str, path_b: str, pattern: str, kind: str = "end", max_pairs: int = MAX_PAIRS, **columns) -> DataFrame:
    """Alignment of every document with its links' corpus-wide counts."""
    found, _ = store(aligned(docs, path_a, path_b, pattern, kind, **columns), "aligned")
    counts, _ = store(pair_counts(found), "pairs")
    return scored(found, counts, counts.count() <= max_pairs)
