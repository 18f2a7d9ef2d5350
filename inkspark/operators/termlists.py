"""Notes' words, counted once and kept small: a list for each note, and lists by term.

A cosine does not change with a note's length, so a term's weight in a note is
its count times the term's idf, and nothing but counts is stored. Words are
found by Spark; Arrow batches count them, since a note's words lie in one row
and need no shuffle to meet, and turn lists by note into lists by term, which
say a term once for many notes. Rows of (note, term) would take several times
the input on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.names import stem
from ..lineage import remove, stored

#: Words that a task counts at once.
TOKENS = 500_000
#: Entries that a task turns into lists by term at once.
CHUNK = 1_000_000
#: Entries whose squares and products a task sums by note at once.
SUMS = 1_500_000
#: Notes up to which their norms are broadcast.
FEW_NOTES = 1_000_000
#: Notes of a span, as a power of two.
SPAN = 20
#: Levels of impact: each is eight to a factor of two, the last holds all below.
LEVELS, STEPS = 127, 8

BAG = "array<struct<term:string,n:int,word:int>>"
LIST = "term string, first long, at array<int>, n array<int>"


def _values(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches with at most so many entries in a column's lists; a longer list stands alone."""
    for batch in batches:
        ends, start = np.cumsum(_sizes(batch.column(column))), 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size, bag of each row (…, tokens, more): distinct words with their count as terms, and in how many rows they are significant.

    ``more`` are significant words besides the tokens; a row where it is null has none at all.
    """
    common, minor = pa.array(md.COMMON_WORDS), pa.array(md.MINOR_WORDS)
    for batch in _cut(batches, "tokens", TOKENS):
        tokens, more = batch.column("tokens"), batch.column("more")
        said = tokens.flatten()
        words = pa.concat_arrays([said, more.flatten()]).dictionary_encode()
        known, codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
        rows = np.concatenate([np.repeat(np.arange(len(batch)), _sizes(x)) for x in (tokens, more)])
        is_term = pc.and_(pc.greater_equal(pc.utf8_length(known), 3), pc.invert(pc.is_in(known, common))).to_numpy(zero_copy_only=False)
        plain = pc.and_(pc.greater_equal(pc.binary_length(known), 3), pc.invert(pc.is_in(known, minor)))
        is_word = pc.and_(plain, pc.invert(pc.match_substring(known, "_"))).to_numpy(zero_copy_only=False)
        found, place = np.unique(rows * max(1, len(known)) + codes, return_inverse=True)
        row, code = found // max(1, len(known)), found % max(1, len(known))
        times, extra = np.bincount(place[: len(said)], minlength=len(found)), np.bincount(place[len(said) :], minlength=len(found)) > 0
        n, word = np.where(is_term[code], times, 0), ((times > 0) & is_word[code] | extra) & more.is_valid().to_numpy(zero_copy_only=False)[row]
        keep = (n > 0) | word
        entry = pa.StructArray.from_arrays([known.take(pa.array(code[keep])), pa.array(n[keep], pa.int32()), pa.array(word[keep], pa.int32())], ["term", "n", "word"])
        rest = [c for c in batch.schema.names if c not in ("tokens", "more")]
        sizes = np.bincount(row[keep], minlength=len(batch))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sizes, pa.int32()), _lists(entry, sizes)], [*rest, "size", "bag"])


def bags(notes: DataFrame, folder: str) -> tuple[str, int]:
    """The folder, ``folder`` or one beside it, of m, path, order, links, size, bag of every note (path, content), and how many rows there were.

    ``m`` numbers the rows, ascending in every file. Rows of one path are one
    note; only where there are some is the table written a second time.
    """
    numbered = lambda rows: rows.select(F.monotonically_increasing_id().alias("m"), "path", "order", "links", "size", "bag")
    none = F.array().cast("array<string>")
    title, raw = md.title("path", "content"), F.regexp_extract_all("content", F.lit(md.WORD_SIGN + "+"), F.lit(0))
    found = notes.select("path", title.alias("title"), md.links("content").alias("links"), raw.alias("raw"))
    pieces = F.transform(F.flatten(F.transform(F.filter("raw", lambda x: x.contains("_")), lambda x: F.split(x, "_"))), F.lower)
    pieces = F.filter(pieces, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*md.MINOR_WORDS))
    tokens = found.select(
        "path", F.lower("title").alias("order"), F.coalesce("links", none).alias("links"),
        F.coalesce(F.transform("raw", F.lower), none).alias("tokens"), F.concat(pieces, md.significant_terms("title")).alias("more"),
    )
    read = stored(numbered(tokens.mapInArrow(_counted, f"path string, order string, links array<string>, size int, bag {BAG}")), folder)
    total = read.count()
    again = read.groupBy("path").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("path").alias("_path"))
    if not again.limit(1).count():
        return folder, total
    same = F.col("path").eqNullSafe(F.col("_path"))
    several = read.join(again, same, "left_semi")
    bag = several.select("path", F.inline("bag")).groupBy("path", "term").agg(F.sum("n").cast("int").alias("n"), F.sum("word").cast("int").alias("word"))
    bag = bag.groupBy("path").agg(F.collect_list(F.struct("term", "n", "word")).alias("bag")).withColumnRenamed("path", "_path")
    heads = several.groupBy("path").agg(F.max("order").alias("order"), F.flatten(F.collect_list("links")).alias("links"))
    merged = heads.join(bag, same, "left").select("path", "order", "links", F.coalesce("bag", F.array().cast(BAG)).alias("bag"))
    alone = read.join(again, same, "left_anti").select("path", "order", "links", "bag")
    stored(numbered(alone.unionByName(merged).withColumn("size", F.size("bag"))), f"{folder}-once")
    remove(notes.sparkSession, folder)
    return f"{folder}-once", total


def numbered(held: DataFrame) -> DataFrame:
    """``held`` with gapless ids in the order of ``m``. The files' sizes are summed, of which there are as many as tasks wrote."""
    part = F.shiftright("m", 33)
    below, first = 0, []
    for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        first.append((r.part, below - (r.part << 33)))
        below += r.n
    table = held.sparkSession.createDataFrame(first, "_part long, _shift long")
    return held.join(F.broadcast(table), part == F.col("_part")).withColumn("id", F.col("m") + F.col("_shift")).drop("_part", "_shift")


def _turned(batches: Iterator[pa.RecordBatch], more: bool) -> Iterator[pa.RecordBatch]:
    """Lists by term of rows (id, bag) or (id, bag, norm); with ``more`` also of impacts' levels and of words."""
    hold, size = [], 0
    for batch in _cut(batches, "bag", CHUNK):
        hold.append(batch)
        size += len(batch.column("bag").flatten())
        if size >= CHUNK:
            yield from _by_term(hold, more)
            hold, size = [], 0
    if size:
        yield from _by_term(hold, more)


def _by_term(hold: list[pa.RecordBatch], more: bool) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(hold)
    bag, ids = _values(table.column("bag")), table.column("id").to_numpy()
    entry, row = bag.flatten(), np.repeat(np.arange(len(ids), dtype=np.int32), _sizes(bag))
    n = entry.field("n").to_numpy()
    keep = np.arange(len(row)) if more else np.flatnonzero(n > 0)
    if not len(keep):
        return
    terms = entry.field("term") if more else entry.field("term").take(pa.array(keep))
    terms = terms.dictionary_encode()
    key = (terms.indices.to_numpy().astype(np.int64) << 32) | np.arange(len(keep))
    key.sort()
    sizes = np.bincount(key >> 32, minlength=len(terms.dictionary))
    key &= 0xFFFFFFFF
    at, first = keep[key], int(ids.min())
    columns = {"at": (ids - first).astype(np.int32)[row[at]], "n": n[at]}
    if more:
        norm = table.column("norm").to_numpy()
        columns |= {"level": level(columns["n"] / np.where(norm > 0, norm, 1).astype(np.float32)[row[at]]), "word": entry.field("word").to_numpy()[at]}
    lists = [_lists(pa.array(v), sizes) for v in columns.values()]
    whole = pa.RecordBatch.from_arrays([terms.dictionary, pa.array(np.full(len(sizes), first)), *lists], ["term", "first", *columns])
    del key, at, keep, row, n, entry, bag, table, terms, lists, columns
    hold.clear()
    pa.default_memory_pool().release_unused()
    for start in range(0, len(whole), 20_000):
        yield whole.slice(start, 20_000)


def level(impact: np.ndarray) -> np.ndarray:
    """Levels of impacts (0 to 1), falling; of no impact the last."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(-np.log2(impact.astype(np.float32)) * STEPS), 0, LEVELS).astype(np.int8)


def bound(levels: np.ndarray) -> np.ndarray:
    """What no impact of a level exceeds; levels are taken in single precision."""
    return np.exp2(-levels.astype(float) / STEPS) * (1 + 1e-5)


def by_term(rows: DataFrame) -> DataFrame:
    """term, first, at, n: of rows (id, bag) lists of the notes that have a term, ``first`` added to each of ``at``."""
    return rows.select("id", "bag").mapInArrow(lambda batches: _turned(batches, False), LIST)


def by_impact(rows: DataFrame) -> DataFrame:
    """The same of rows (id, bag, norm) with levels of impact, and of words that are no terms (n is 0)."""
    return rows.select("id", "bag", "norm").mapInArrow(lambda batches: _turned(batches, True), f"{LIST}, level array<tinyint>, word array<int>")


def _summed(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    """id, squares, dot: sums over the lists of a task, many at a time."""

    def out() -> pa.RecordBatch:
        found, place = np.unique(np.concatenate([x[0] for x in hold]), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([x[k] for x in hold]), len(found)) for k in (1, 2)]
        pa.default_memory_pool().release_unused()
        return pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], ["id", "squares", "dot"])

    hold, size = [], 0
    for batch in _cut(batches, "at", SUMS):
        sizes = _sizes(batch.column("at"))
        idf = np.log(total / batch.column("df").to_numpy().astype(float)) + 1
        own = batch.column("own").to_numpy(zero_copy_only=False).astype(float) * idf
        w = batch.column("n").flatten().to_numpy() * np.repeat(idf, sizes)
        hold.append((np.repeat(batch.column("first").to_numpy(), sizes) + batch.column("at").flatten().to_numpy(), w * w, w * np.repeat(own, sizes)))
        size += len(w)
        if size >= SUMS:
            yield out()
            hold, size = [], 0
    if hold:
        yield out()


def sums(rows: DataFrame, total: int, mine: DataFrame | None = None) -> DataFrame:
    """id, squares, dot of rows (id, bag): the sum of a note's squared weights, and of its products with ``mine`` (term, own), a note's counts.

    A term's lists meet in one task, a row for each ``CHUNK`` of notes; it is
    those rows that a task holds at once, not the notes.
    """
    lists = by_term(rows).withColumn("df", F.sum(F.size("at")).over(Window.partitionBy("term")))
    if mine is None:
        lists = lists.withColumn("own", F.lit(0))
    else:
        lists = lists.join(F.broadcast(mine), "term", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    parts = lists.select("first", "at", "n", "df", "own").mapInArrow(lambda batches: _summed(batches, total), "id long, squares double, dot double")
    return parts.groupBy("id").agg(F.sum("squares").alias("squares"), F.sum("dot").alias("dot"))


def _laid(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (bucket, term, span, first, at, n, level, word) that come sorted by the first four.

    A term's lists of one span are put together, by falling impact. The last
    term and span of what is held waits for what may follow.
    """
    hold, size = [], 0
    for batch in _cut(batches, "at", SUMS):
        hold.append(batch)
        size += int(_sizes(batch.column("at")).sum())
        if size < SUMS:
            continue
        table = pa.Table.from_batches(hold)
        last = table.num_rows - 1
        same = pc.and_(pc.equal(table["term"], table["term"][last]), pc.equal(table["span"], table["span"][last]))
        start = int(pc.index(same, True).as_py())
        if start:
            yield from _blocks(table.slice(0, start), block)
        hold = table.slice(start).to_batches()
        size = sum(int(_sizes(b.column("at")).sum()) for b in hold)
        if not start:  # one term's lists are held to their end
            size = 0
    if hold:
        yield from _blocks(pa.Table.from_batches(hold), block)


def _blocks(table: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
    terms = _values(table["term"])
    codes, spans = terms.dictionary_encode().indices.to_numpy(), table["span"].to_numpy()
    begins = np.concatenate([[True], (codes[1:] != codes[:-1]) | (spans[1:] != spans[:-1])])
    at = _values(table["at"])
    sizes, row = _sizes(at), np.flatnonzero(begins)
    group = np.repeat(np.cumsum(begins) - 1, sizes)
    levels = _values(table["level"]).flatten().to_numpy()
    key = ((group.astype(np.int64) * (LEVELS + 1) + levels) << 32) | np.arange(len(group))
    key.sort()
    order, group = key & 0xFFFFFFFF, (key >> 32) // (LEVELS + 1)
    n = _values(table["n"]).flatten().to_numpy()[order]
    held = np.bincount(group, minlength=len(row))
    place = np.arange(len(group)) - np.repeat(np.cumsum(held) - held, held)
    starts = np.flatnonzero(place % block == 0)
    lengths = np.diff(np.concatenate([starts, [len(group)]]))
    ids = (np.repeat(table["first"].to_numpy(), sizes) + at.flatten().to_numpy())[order]
    word = _values(table["word"]).flatten().to_numpy()[order]
    mine = group[starts]
    df = np.bincount(group, n > 0, minlength=len(row)).astype(np.int64)
    rows = pa.array(row[mine])
    whole = pa.RecordBatch.from_arrays(
        [
            _values(table["bucket"]).take(rows), terms.take(rows), pa.array((place[starts] // block).astype(np.int32)), pa.array(df[mine]),
            pa.array(bound(levels[order][starts])), _lists(pa.array(ids), lengths), _lists(pa.array(n, pa.int32()), lengths), _lists(pa.array(word), lengths),
        ],
        ["bucket", "term", "block", "df", "best", "ids", "n", "word"],
    )
    pa.default_memory_pool().release_unused()
    for start in range(0, len(whole), 20_000):
        yield whole.slice(start, 20_000)


def blocks(lists: DataFrame, tasks: int, task: Column, block: int) -> DataFrame:
    """bucket, term, block, df, best, ids, n, word of lists by impact with a ``bucket``, laid by ``task`` (below ``tasks``).

    The lists of a term lie in spans of ``SPAN`` notes, each in a task of its
    own and numbered from 0; ``df`` counts the notes of a span that have the
    term, and ``best`` exceeds count over norm of a block's every note.
    """
    spans = lists.withColumn("span", F.shiftright("first", SPAN))
    dealt = spans.repartitionById(tasks, F.pmod(task + F.col("span"), F.lit(tasks)).cast("int")).sortWithinPartitions("bucket", "term", "span", "first")
    kept = dealt.select("bucket", "term", "span", "first", "at", "n", "level", "word")
    return kept.mapInArrow(lambda batches: _laid(batches, block), "bucket int, term string, block int, df long, best double, ids array<long>, n array<int>, word array<int>")


def resolved(held: DataFrame) -> DataFrame:
    """src, target, name, dst: the links of ``held`` (path, order, links), as ``graph.resolved`` gives them."""
    rows = held.select(F.col("path").alias("src"), F.explode("links").alias("target")).withColumn("name", F.lower("target"))
    return rows.join(answering(held), "name", "left")


def answering(held: DataFrame) -> DataFrame:
    """name -> dst, as ``graph.names`` has them."""
    return held.select(F.lower(stem("path")).alias("name"), "path", "order").groupBy("name").agg(F.max_by("path", F.struct("order", "path")).alias("dst"))


def neighbours(held: DataFrame, path: str) -> DataFrame:
    """path: the notes that ``path`` links to, and those that link to it. Only names that it has to do with are looked up."""
    name = F.lower(stem(F.lit(path)))
    rows = held.select(F.col("path").alias("src"), F.explode("links").alias("target")).withColumn("name", F.lower("target")).where((F.col("src") == path) | (F.col("name") == name))
    asked = rows.select("name").distinct()
    known = answering(held.join(asked, F.lower(stem("path")) == F.col("name"), "left_semi"))
    met = rows.join(known, "name").where((F.col("src") == path) | (F.col("dst") == path))
    return met.select(F.explode(F.array("src", "dst")).alias("path")).where(F.col("path") != path).distinct()
