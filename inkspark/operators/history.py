"""Versions of notes: snapshots without repeats, throttled and capped, and line diffs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

KEEP = 50


def distinct_ids(log: DataFrame) -> DataFrame:
    """``log`` (path, taken_at, tie) with ``id``: the first free millisecond from taken_at on."""
    order = Window.partitionBy("path").orderBy("taken_at", "tie")
    n = F.row_number().over(order)
    numbered = log.withColumn("n", n)
    running = F.max(F.col("taken_at") - F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("id", running + F.col("n")).drop("n")


def without_repeats(log: DataFrame) -> DataFrame:
    """Snapshots that differ from the one before."""
    before = F.lag("content").over(Window.partitionBy("path").orderBy("taken_at", "tie"))
    return log.withColumn("before", before).where(~F.col("content").eqNullSafe(F.col("before")) | F.col("before").isNull()).drop("before")


def newest(log: DataFrame, keep: int = KEEP) -> DataFrame:
    """The newest ``keep`` snapshots of each note."""
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("taken_at"), F.desc("tie")))
    return log.withColumn("n", n).where(F.col("n") <= keep).drop("n")


def throttled(log: DataFrame, seconds: int) -> DataFrame:
    """path, taken_at, tie of snapshots at least ``seconds`` after the last one kept.

    The rule looks back at what it kept itself, so each note's log is folded
    in order, batch by batch; only the last kept time is held.
    """
    columns = ["path", "taken_at", "tie"]
    step = seconds * 1000

    def fold(batches: Iterator) -> Iterator:
        last: tuple[str | None, int] = (None, 0)
        for rows in batches:
            keep = []
            for path, at in zip(rows["path"], rows["taken_at"]):
                due = path != last[0] or at - last[1] >= step
                keep.append(due)
                if due:
                    last = (path, at)
            yield rows[keep]

    dealt = log.select(*columns).repartition("path").sortWithinPartitions("path", "taken_at", "tie")
    return dealt.mapInPandas(fold, log.select(*columns).schema)


def versions(log: DataFrame, keep: int = KEEP) -> DataFrame:
    """What the store holds after all snapshots: path, id, taken_at, bytes, content."""
    held = newest(without_repeats(distinct_ids(log)), keep)
    return held.select("path", "id", "taken_at", F.octet_length("content").cast("long").alias("bytes"), "content")


def restore(log: DataFrame, path: str, version: int, now: int) -> DataFrame:
    """Snapshots that restoring ``version`` adds: what the note held, then the old content again."""
    mine = log.where(F.col("path") == path)
    current = mine.orderBy(F.desc("taken_at")).limit(1).select("path", F.lit(now).cast("long").alias("taken_at"), "content")
    old = mine.where(F.col("taken_at") == version).select("path", F.lit(now + 1).cast("long").alias("taken_at"), "content")
    return current.unionByName(old)


def forget(log: DataFrame, path: str) -> DataFrame:
    return log.where(F.col("path") != path)


def relocate(log: DataFrame, old: str, new: str) -> DataFrame:
    return log.withColumn("path", F.when(F.col("path") == old, new).otherwise(F.col("path")))


def _rows_of_bits(a: list[int], masks: dict[int, int], full: int, row: int) -> list[int]:
    """Bit rows of longest common tails: from ``row`` on, one more line of ``a`` (last first) to each.

    Bit j of a row is set where the j-th line of the other text, counted from
    its end, makes the longest common tail no longer. All columns of a row are
    found at once by the carries of one addition.
    """
    out = [row]
    for line in a:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        out.append(row)
    return out


def diff_rows(before: str | None, after: str | None) -> list[tuple[int, str, str]]:
    """Smallest line diff as (pos, kind, text); of equally small ones the one that keeps, then deletes, earliest.

    Common ends are set aside. Of the rest every so many rows of bits are
    held and those between are made again when they are needed, so memory grows
    with the lines times the square root of their number, in bits.
    """
    a, b = (before or "").split("\n"), (after or "").split("\n")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    number: dict[str, int] = {}
    left, right = ([number.setdefault(s, len(number)) for s in z] for z in (x, y))
    n, m = len(left), len(right)
    masks: dict[int, int] = {}
    for j, line in enumerate(reversed(right)):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << m) - 1
    turned, block = left[::-1], max(1, int(n**0.5))
    marks, row = [full], full
    for at in range(0, n, block):
        row = _rows_of_bits(turned[at : at + block], masks, full, row)[-1]
        marks.append(row)
    held: tuple[int, list[int]] = (-1, [])

    def common(i: int, j: int) -> int:
        """Lines that the rests of both texts from i and j on have in common."""
        nonlocal held
        k = (n - i) // block
        if held[0] != k:
            held = k, _rows_of_bits(turned[k * block : (k + 1) * block], masks, full, marks[k])
        bits = held[1][n - i - k * block] & ((1 << m - j) - 1)
        return m - j - bits.bit_count()

    rows, i, j = [("same", s) for s in a[:head]], 0, 0
    while i < n or j < m:
        if i < n and j < m and left[i] == right[j]:
            rows.append(("same", x[i]))
            i, j = i + 1, j + 1
        elif i < n and (j == m or common(i + 1, j) == common(i, j)):
            rows.append(("del", x[i]))
            i += 1
        else:
            rows.append(("add", y[j]))
            j += 1
    rows += [("same", s) for s in a[len(a) - tail :]] if tail else []
    return [(at, *r) for at, r in enumerate(rows)]


@udtf(returnType="pos int, kind string, text string")
class LineDiff:
    """Table function (before, after) -> rows of the diff."""

    def eval(self, before: str, after: str):
        yield from diff_rows(before, after)


def diffs(pairs: DataFrame) -> DataFrame:
    """id, pos, kind, text for each (id, before, after)."""
    spark = pairs.sparkSession
    spark.udtf.register("line_diff", LineDiff)
    pairs.createOrReplaceTempView("_diff_pairs")
    return spark.sql("SELECT p.id, d.pos, d.kind, d.text FROM _diff_pairs p, LATERAL line_diff(p.before, p.after) d")
