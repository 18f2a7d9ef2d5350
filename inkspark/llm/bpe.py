"""Byte-level BPE encoding and decoding.

A piece of text (one match of the split pattern) is mapped byte by byte to
Latin-1 and cut into leftmost-longest vocabulary entries by an Aho-Corasick
automaton. A sequence of tokens is the result of the byte-pair merges exactly
if each token reproduces itself and each adjacent pair, encoded together, comes
out as that pair. Pair checks are memoised; where one fails, the search goes
back to the next shorter token. Positions that turned out to be dead ends are
remembered, so every position is left at most once for each token that ends
there and the work stays linear in the piece.

Whole pieces that are vocabulary entries are single tokens, as in the tiktoken
library.

Defined results: a null text encodes like an empty one (no ids); equal rows
give equal results; an empty table gives an empty result; a very long text is
encoded whole, piece by piece, each in linear time; where several tokens are
as long the merges decide, so there are no ties; a column named like a result
is replaced, others are carried along.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries after which a worker's memo of pieces or pairs starts anew.
MEMO = 400_000
#: Longest piece that is memoised.
MEMO_CHARS = 40


class Pieces(dict):
    """Memo from a piece to its packed ids, filled on demand."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.bpe.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = packed
        return packed


class Bpe:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(spaces(pattern)).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.pieces = Pieces(self)

    def merge(self, text: bytes) -> list[int]:
        """Ids by the merges themselves, for the few bytes of a pair."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 31), i) for i in range(len(parts) - 1))
            if rank == 1 << 31:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def stands(self, token: int) -> bool:
        """Whether the merges make this token from its own bytes."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.tokens[token]) == [token]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        text = piece.decode("latin-1")
        path = [rank for _, rank in self.automaton.iter_long(text)]
        for i, token in enumerate(path):
            if not self.stands(token) or i and not self.fits(path[i - 1], token):
                return self._search(piece, path[:i])
        return path

    def _search(self, piece: bytes, path: list[int]) -> list[int]:
        """Depth-first from longest tokens; ``path`` is a prefix whose pairs fit.

        The automaton gives all tokens that begin at each place, in one pass.
        """
        end = len(piece)
        at = sum(len(self.tokens[t]) for t in path)
        begin: list[list[int]] = [[] for _ in range(end)]
        for last, token in self.automaton.iter(piece.decode("latin-1")):
            begin[last + 1 - len(self.tokens[token])].append(token)  # the shorter first, as they end earlier
        dead: set[tuple[int, int]] = set()
        left = len(begin[at])
        while at < end:
            step = None
            while left:
                left -= 1
                token = begin[at][left]
                if (at, token) not in dead and self.stands(token) and (not path or self.fits(path[-1], token)):
                    step = token
                    break
            if step is not None:
                path.append(step)
                at += len(self.tokens[step])
                left = len(begin[at]) if at < end else 0
            else:
                last = path.pop()
                at -= len(self.tokens[last])
                dead.add((at, last))
                left = begin[at].index(last)
        return path

    def encode(self, text: str) -> bytes:
        """Packed little-endian 32-bit ids of a whole text."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def spaces(pattern: str) -> str:
    """The pattern with white space as Unicode defines it; Python's own class has four more control characters."""
    white = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    outside = pattern.replace(r"[^\s", f"[^{white}")
    return outside.replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]")


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """One coder for each worker process and vocabulary."""
    return Bpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the packed ids (binary) of each whole text."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    carry = [c for c in docs.columns if c != ids_col]
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(ids_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            texts = batch.column(carry.index(text_col))
            for at in range(0, batch.num_rows, 500):
                part = texts.slice(at, 500)
                ids = [coder.encode(x.as_py() or "") for x in part]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 500) for c in batch.columns), pa.array(ids, pa.binary())], names=[*carry, ids_col])

    return docs.select(*[F.col(f"`{c}`") for c in carry]).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``: the bytes (binary) that the packed ids stand for."""
    from pyspark.sql import types as T

    carry = [c for c in encoded.columns if c != out_col]
    schema = T.StructType([encoded.schema[c] for c in carry] + [T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            ids = batch.column(carry.index(ids_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([coder.decode(x.as_py() or b"") for x in ids], pa.binary())], names=[*carry, out_col])

    return encoded.select(*carry).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; token counts and SHA-256 digests of both."""
    from pyspark.sql import functions as F

    coded = decode(encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path, pattern).select("doc_id", "ids"), path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
