"""Merkle manifest of a dataset: a tree for each source, a tree over the sources, and a proof for each row.

A row's leaf is the SHA-256 of its fields, each written as ``-`` (null) or as
its UTF-8 byte count, a colon and its value. Leaves of a source ascend by id;
every ``ARITY`` consecutive nodes (fewer at the end) become their hash until
one is left, the subroot. The subroots, in the bytewise order of sources (null
first), become the root in the same way. Digests are lower-case hexadecimal
text, also where they are hashed again.

Trees are cut into aligned blocks of ``ARITY ** HEIGHT`` nodes. A first pass
reduces every block to its top node; tops are the nodes of the next layer, until
each tree is one node. On the way down every block meets the one path that all
its nodes share above it, and a fractal traversal emits the paths within:
for each tier of levels it keeps the subtree that holds the current leaf, and
grows the next one by a leaf a step, so that it is complete when it is needed.

Defined results: null fields are ``-``, an empty text is ``0:``; null ids come
first among a source's leaves; rows of equal id stand in the order of their
leaf digests, and equal rows have leaves and places of their own; a null source
is a source of its own; a very long text is one value, hashed whole; an empty
table gives an empty manifest; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop, scratch_path, store
from ..operators.rewrite import numbered

ARITY, HEIGHT, TIER = 3, 6, 2
#: Rows of the table of ranges (one for each task and source in it) up to which it is broadcast.
MAX_BROADCAST = 200_000
PATH = "array<struct<before:string,after:string>>"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def joined(nodes: list[str]) -> str:
    """The parent of consecutive nodes."""
    return sha256("".join(nodes).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def depth(first: bool, size: int) -> int:
    """Levels above the nodes of a block: all of ``HEIGHT`` unless the block is its whole tree."""
    if not first or size == ARITY**HEIGHT:
        return HEIGHT
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


class Subtree:
    """The nodes of the levels ``low`` to ``high - 1`` under one node of level ``high``, grown a leaf at a time."""

    def __init__(self, leaves: list[str], low: int, high: int, which: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.at, self.end = which * ARITY**high, min((which + 1) * ARITY**high, len(leaves))
        self.nodes: dict[tuple[int, int], str] = {}
        self.open: list[list[str]] = [[] for _ in range(high)]

    def grow(self) -> bool:
        """Take in the next leaf; whether there was one."""
        if self.at >= self.end:
            return False
        level, i, digest = 0, self.at, self.leaves[self.at]
        self.at += 1
        while level < self.high:
            if level >= self.low:
                self.nodes[level, i] = digest
            run = self.open[level]
            run.append(digest)
            if i % ARITY != ARITY - 1 and self.at < self.end:
                break
            digest = joined(run)
            run.clear()
            level, i = level + 1, i // ARITY
        return True

    def whole(self) -> Subtree:
        while self.grow():
            pass
        return self


def top(leaves: list[str], levels: int) -> str:
    """The node ``levels`` above a block's nodes."""
    for _ in range(levels):
        leaves = [joined(leaves[i : i + ARITY]) for i in range(0, len(leaves), ARITY)]
    return leaves[0]


def paths(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn, its siblings before and after it at each of ``levels`` levels.

    Holds two subtrees of ``TIER`` levels for each tier, beside the leaves.
    """
    spans = [(low, min(low + TIER, levels)) for low in range(0, levels, TIER)]
    here = [Subtree(leaves, low, high, 0).whole() for low, high in spans]
    ahead = [Subtree(leaves, low, high, 1) for low, high in spans]
    sizes = [-(-len(leaves) // ARITY**level) for level in range(levels)]
    for at in range(len(leaves)):
        found = []
        for t, (low, high) in enumerate(spans):
            which, into = divmod(at, ARITY**high)
            if which and not into:
                here[t], ahead[t] = ahead[t].whole(), Subtree(leaves, low, high, which + 1)
            nodes = here[t].nodes
            for level in range(low, high):
                i = at // ARITY**level
                first = i - i % ARITY
                last = min(first + ARITY, sizes[level])
                found.append(("".join(nodes[level, j] for j in range(first, i)), "".join(nodes[level, j] for j in range(i + 1, last))))
            ahead[t].grow()
        yield found


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {ARITY**HEIGHT}"))


def _above(nodes: DataFrame) -> DataFrame:
    """key, pos, digest of the blocks' top nodes."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        first = rows["block"][0].as_py()
        digest = top(rows["digest"].to_pylist(), depth(first == 0, rows.num_rows))
        return pa.table({"key": rows["key"].slice(0, 1), "pos": pa.array([first], pa.int64()), "digest": pa.array([digest])})

    return _blocks(nodes.select("key", "pos", "digest")).groupBy("key", "block").applyInArrow(run, "key string, pos long, digest string")


def _below(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """``nodes`` with their paths: those within the block, then the one that ``up`` (key, pos, path, root, subroot) has for the block."""
    names = [f.name for f in nodes.schema]

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n, levels = rows.num_rows, depth(rows["block"][0].as_py() == 0, rows.num_rows)
        rest = [(s["before"], s["after"]) for s in above["path"][0].as_py()]
        flat = [s for p in paths(rows["digest"].to_pylist(), levels) for s in (*p, *rest)]
        steps = pa.StructArray.from_arrays([pa.array([b for b, _ in flat], pa.string()), pa.array([a for _, a in flat], pa.string())], fields=list(_STEP))
        each = levels + len(rest)
        path = pa.ListArray.from_arrays(pa.array(range(0, n * each + 1, each) if each else [0] * (n + 1), pa.int32()), steps)
        same = {c: pa.array([above[c][0].as_py()] * n, pa.string()) for c in ("root", "subroot")}
        return pa.table({c: rows[c] for c in names} | {"path": path} | same)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    over = up.withColumnRenamed("pos", "block")
    return _blocks(nodes).groupBy("key", "block").cogroup(over.groupBy("key", "block")).applyInArrow(run, f"{kinds}, path {PATH}, root string, subroot string")


class Layers:
    """Layers of a forest: the nodes given, and tops of blocks until every tree is one node."""

    def __init__(self, nodes: DataFrame):
        self.nodes, self.kept = [nodes], []
        while self.nodes[-1].where("pos > 0").limit(1).count():
            above, path = store(_above(self.nodes[-1]), "merkle")
            self.nodes.append(above)
            self.kept.append(path)

    def down(self, up: DataFrame) -> DataFrame:
        """The lowest nodes with paths, where ``up`` has key, path, root and subroot for each tree."""
        up = up.withColumn("pos", F.lit(0).cast("long")).select("key", "pos", "path", "root", "subroot")
        for nodes in reversed(self.nodes[1:]):
            up, path = store(_below(nodes, up).select("key", "pos", "path", "root", "subroot"), "merkle")
            self.kept.append(path)
        return _below(self.nodes[0], up)


def placed(leaves: DataFrame, path: str) -> DataFrame:
    """``leaves`` (key, doc_id, digest and others) with ``pos``, the place among those of the key; stored at ``path``.

    Rows are sorted in ranges of (key, doc_id, digest), so a source of any size
    lies in as many tasks as it needs; counts of the ranges give the places.
    """
    spark = leaves.sparkSession
    ranged = leaves.repartitionByRange("key", F.col("doc_id").asc_nulls_first(), "digest").sortWithinPartitions("key", F.col("doc_id").asc_nulls_first(), "digest")
    dealt, dealt_path = store(ranged.withColumn("_at", F.monotonically_increasing_id()), "merkle")
    parts = dealt.groupBy("key", F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("key", "_part", (F.coalesce(below, F.lit(0)) - F.col("_first")).alias("_shift"))
    starts = F.broadcast(starts) if parts.count() <= MAX_BROADCAST else starts
    out = dealt.withColumn("_part", F.shiftright("_at", 33)).join(starts, ["key", "_part"])
    out.select(*leaves.columns, (F.col("_at") + F.col("_shift")).alias("pos")).write.parquet(path)
    drop(spark, dealt_path)
    return spark.read.parquet(path)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(
    docs: DataFrame,
    claimed: Column | None = None,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, source, pos, leaf, path, subroot, root of every row, and with ``claimed`` a verdict.

    ``path`` has for each level, from the leaf to the root, the siblings' digests
    before and after. ``claimed`` stands for the text that a row is said to
    have: ``folded_root`` is what its leaf and the row's path lead to, and
    ``verified`` whether that is the root.
    """
    spark = docs.sparkSession
    cols = [F.col(f"`{c}`") for c in fields]
    other = leaf(*[cols[i] if c != text_col or claimed is None else claimed for i, c in enumerate(fields)])
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    rows = docs.select(key.alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf(*cols).alias("digest"), *([] if claimed is None else [other.alias("claim")]))
    leaves, leaves_path = store(rows, "merkle")
    placed_path = scratch_path(spark, "merkle")
    nodes = placed(leaves, placed_path)
    drop(spark, leaves_path)
    docs_layers = Layers(nodes)
    subroots, subroots_path = store(docs_layers.nodes[-1].select("key", F.col("digest")), "merkle")
    ranked = numbered(subroots, "key").select(F.lit("").alias("key"), F.col("key").alias("source"), "pos", "digest")
    ranked, ranked_path = store(ranked, "merkle")
    source_layers = Layers(ranked)
    top_node = source_layers.nodes[-1].select("key", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"), F.lit("").alias("subroot"))
    sources = source_layers.down(top_node).select(F.col("source").alias("key"), "path", "root", F.col("digest").alias("subroot"))
    sources, _ = store(sources, "merkle")
    for path in (subroots_path, ranked_path, *source_layers.kept):
        drop(spark, path)
    out = docs_layers.down(sources)
    out = out.withColumn("source", F.when(F.col("key") != "", F.substr("key", F.lit(2)))).withColumnRenamed("digest", "leaf")
    keep = ["doc_id", "source", "pos", "leaf", "path", "subroot", "root"]
    if claimed is None:
        return out.select(keep)
    out = out.select(*keep, fold(F.col("claim"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def without_breaks(every: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, without its line breaks where ``every`` divides the id's crc32: a change for the proofs to find."""
    changed = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return F.when(changed, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))


#: The same result in DuckDB: levels by recursion; crc32's lowest bit by its table of one bit a step.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) & 1 AS odd
  FROM documents),
l AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND odd = 1 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claim
  FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos FROM l),
t(source, level, pos, digest, size) AS (
  SELECT source, 0, pos, leaf, count(*) OVER (PARTITION BY source) FROM p
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((size + 2) // 3) FROM t WHERE size > 1 GROUP BY source, level, pos // 3),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM t WHERE size = 1),
u(level, pos, digest, size) AS (
  SELECT 0, pos, subroot, size FROM s
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((size + 2) // 3) FROM u WHERE size > 1 GROUP BY level, pos // 3),
r AS (SELECT digest AS root FROM u WHERE size = 1),
tw AS (SELECT a.source, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM t a JOIN t b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.size > 1 GROUP BY a.source, a.level, a.pos),
uw AS (SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM u a JOIN u b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.size > 1 GROUP BY a.level, a.pos),
steps AS (
  SELECT p.row, 0 AS tree, tw.level, tw.before, tw.after FROM p JOIN tw ON p.source IS NOT DISTINCT FROM tw.source AND tw.pos = p.pos // CAST(3 ** tw.level AS BIGINT)
  UNION ALL
  SELECT p.row, 1, uw.level, uw.before, uw.after FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN uw ON uw.pos = s.pos // CAST(3 ** uw.level AS BIGINT)),
w AS (SELECT row, list({'before': before, 'after': after} ORDER BY tree, level) AS path FROM steps GROUP BY row),
f(row, step, h, path) AS (
  SELECT p.row, 0, p.claim, coalesce(w.path, []) FROM p LEFT JOIN w USING (row)
  UNION ALL
  SELECT row, step + 1, sha256(path[step + 1].before || h || path[step + 1].after), path FROM f WHERE step < len(path)),
e AS (SELECT row, h, sha256(array_to_string(list_transform(path, lambda x: x.before || x.after), '')) AS proof FROM f WHERE step = len(path))
SELECT p.doc_id, p.leaf, s.subroot, r.root, e.proof AS proof_sha256, e.h AS folded_root, e.h = r.root AS verified
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN e USING (row) CROSS JOIN r
"""
