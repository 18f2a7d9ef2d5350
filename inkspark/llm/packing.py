"""Best-fit-decreasing packing of tokenised documents into sequences.

A document is its token ids followed by one separator id. Documents longer
than a sequence are cut into full pieces, the first of which takes the
remainder and so may be shorter. Pieces are dealt by hash into bins of work of
about ``per_task`` sequences; within each, Spark sorts them by falling length
and a segment tree over the remaining capacities of open sequences finds the
tightest one that still fits, in logarithmic time for each piece.

Defined results: a null or empty text has the separator alone; a null id is
kept; equal rows are packed separately; pieces of one length come in the order
of id and piece; a very long text is encoded whole and only its pieces are
moved; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters on which the two tokenizer libraries' classes certainly agree: Latin, and general punctuation.
_PLAIN = r"[^\x00-\u024f\u2010-\u2027\u2030-\u205e]"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Coder:
    """Ids of whole texts by a ``tokenizers`` file.

    A byte-level vocabulary whose ids follow the order of its merges means the
    same to the tiktoken library, which is several times as fast; it is given
    the file's own vocabulary. Texts that hold an added token's string, or
    characters beyond ``_PLAIN``, and files of another kind go through the
    ``tokenizers`` library itself.
    """

    def __init__(self, path: str, pattern: str):
        import json

        import regex
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        added = {t["content"] for t in parts.get("added_tokens", [])}
        self.odd = regex.compile("|".join([_PLAIN, *map(regex.escape, sorted(added))])).search
        vocabulary, merges = parts["model"]["vocab"], parts["model"]["merges"]
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        order = [vocabulary[m] for m in joined]
        byte = {c: b for b, c in _byte_signs().items()}
        plain = {t: i for t, i in vocabulary.items() if t not in added}
        self.fast = None
        if order == sorted(order) and len(plain) == 256 + len(set(joined)) and parts.get("normalizer") is None and parts["pre_tokenizer"]["type"] == "ByteLevel" and not parts["pre_tokenizer"]["add_prefix_space"]:
            ranks = {bytes(byte[c] for c in t): i for t, i in plain.items()}
            self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids."""
        if self.fast is None or self.odd(text):
            return np.array(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def pieces(docs: DataFrame, path: str, pattern: str, size: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of at most ``size`` ids; with the packed ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coded, end = coder(path, pattern), np.array([separator], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).slice(at, 500).to_pylist(), batch.column(1).slice(at, 500).to_pylist()):
                    ids = np.append(coded.encode(text or ""), end)
                    n = len(ids)
                    edges = [0, *range(n % size or size, n + 1, size)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = ids[a:b].tobytes()
                        rows.append((doc, k, a, b - a, zlib.crc32(part), part)[: 6 if with_ids else 5])
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES + ", ids binary" * with_ids)


class Bins:
    """Open sequences by remaining capacity, under a segment tree of counts."""

    def __init__(self, size: int):
        self.size = size
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def _tightest(self, least: int) -> int:
        """Smallest remaining capacity of at least ``least`` that some sequence has, or -1."""
        node = least + self.leaves
        if self.tree[node]:
            return least
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.tree[2 * node])
                return node - self.leaves
            node >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        room = self._tightest(length)
        if room < 0:
            room, which = self.size, self.made
            self.made += 1
        else:
            which = self.open[room].pop()
            self._change(room, -1)
        if room > length:
            self.open[room - length].append(which)
            self._change(room - length, 1)
        return which, self.size - room


def pack(parts: DataFrame, size: int = 2048, per_task: int = 20_000) -> DataFrame:
    """``parts`` (with a column ``length`` of at most ``size``) with ``sequence_id`` and ``offset``."""
    parts = cut(parts)
    total = parts.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // (size * per_task)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = Bins(size), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([first + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    dealt = parts.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return dealt.mapInArrow(run, f"{names}, sequence_id long, offset long")
