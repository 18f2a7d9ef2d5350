"""Mentions of all notes' names in all texts, by an automaton over the names.

Names are dealt by hash into shards of a bounded number of characters. A shard
is sent to the tasks, which build an Aho-Corasick automaton of it once and read
every text through it once; each hit is checked for word edges where it stands,
so no text is joined or moved, and names that begin alike cost nothing. There
are as many passes over the texts as shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.names import stem

#: Characters of names in a shard; an automaton takes some fifty bytes for each.
SHARD = 2_000_000


@lru_cache(maxsize=1 << 16)
def _in_word(sign: str) -> bool:
    import regex

    return bool(regex.match(r"[\p{Alphabetic}\p{N}_]", sign))


class Finder:
    """Whole-word occurrences of many names in one pass over a text."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.names, self.automaton = names, ahocorasick.Automaton()
        for i, name in enumerate(names):
            self.automaton.add_word(name, (i, len(name)))
        if names:
            self.automaton.make_automaton()

    def counts(self, text: str) -> dict[str, int]:
        """How often each name stands in ``text`` as whole words, occurrences of one name not overlapping."""
        found: dict[int, int] = {}
        free: dict[int, int] = {}
        size = len(text)
        for end, (i, length) in self.automaton.iter(text) if self.names else ():
            begin = end - length + 1
            if begin and _in_word(text[begin - 1]) or end + 1 < size and _in_word(text[end + 1]):
                continue
            if begin >= free.get(i, 0):
                free[i] = end + 1
                found[i] = found.get(i, 0) + 1
        return {self.names[i]: n for i, n in found.items()}


_built: list[Finder] = []


def _finder(names: list[str]) -> Finder:
    """The automaton of a shard; a worker keeps the last one it built."""
    if not _built or _built[0].names != names:
        _built[:] = [Finder(names)]
    return _built[0]


def _pass(texts: DataFrame, names: list[str]) -> DataFrame:
    """path, name, count of the names that a text has and does not link to."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared.value)
        for batch in batches:
            rows = []
            for path, text, links in zip(*(c.to_pylist() for c in batch.columns)):
                linked = set(links or ())
                rows += [(path, name, n) for name, n in finder.counts(text or "").items() if name not in linked]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], names=["path", "name", "count"])

    return texts.mapInArrow(run, "path string, name string, count long")


def all_mentions(notes: DataFrame, shard: int = SHARD) -> DataFrame:
    """path, dst, count: unlinked mentions of every note's name in every other note.

    Names are compared in lower case and as whole words; names of under three
    characters have no mentions. A name that several notes have is mentioned
    for each of them.
    """
    named = notes.select(F.col("path").alias("dst"), F.lower(stem("path")).alias("name")).where(F.length("name") >= 3)
    shards = max(1, -(-(named.agg(F.sum(F.length("name"))).first()[0] or 0) // shard))
    texts = notes.select("path", F.lower(md.without_links("content")).alias("text"), F.transform(md.links("content"), F.lower).alias("links"))
    passes = [_pass(texts, [r.name for r in named.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == k).select("name").distinct().collect()]) for k in range(shards)]
    return reduce(DataFrame.unionByName, passes).join(named, "name").where("path <> dst").select("path", "dst", "count")
