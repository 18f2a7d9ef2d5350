"""Removal of lines that spread over many sites.

A line is a newline-split piece of a text, compared after trimming spaces,
tabs and carriage returns; it is known by two 64-bit hashes. Lines shorter
than ``min_chars`` code points are no evidence of boilerplate and stay. For
every line a HyperLogLog sketch of its sites is merged by aggregation. An
estimate outside ``[threshold / 2, 2 * threshold)`` decides by itself (at
2**12 registers that is more than 30 standard errors away); the lines inside
get an exact distinct count. A line found on at least ``threshold`` sites is
removed from every document, all its occurrences included. A table of fewer
sites than ``threshold`` loses nothing.

The lines that spread are few beside the lines there are: they are counted,
and broadcast up to ``MAX_BROADCAST``, so that a line that stands in a third
of all documents is no hot key; beyond that they are joined by shuffle.

Defined results: a null text stays null and has no lines; an empty text stays
empty; an empty table stays empty; a null site counts as one site of its own;
equal rows and rows that repeat an id are treated alike; a very long text is
one row of lines like any other; columns that clash with a result column are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import store

LG_REGISTERS = 12
#: Lines up to which they are broadcast (16 bytes each).
MAX_BROADCAST = 1_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    """Two independent hashes, so that a removal does not rest on 64 bits."""
    bare = F.trim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def _counted(line: Column, min_chars: int) -> Column:
    return F.length(F.trim(line, F.lit(" \t\r"))) >= min_chars


def _found(docs: DataFrame, min_chars: int, text_col: str, keep: Column) -> DataFrame:
    """``keep`` beside every distinct counted line (column ``line``) of each row."""
    return docs.select(keep, F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), lambda x: _counted(x, min_chars)), _hash))).alias("line"))


def _known(lines: DataFrame) -> DataFrame:
    """Stored lines with a broadcast hint where they are few."""
    return F.broadcast(lines) if lines.count() <= MAX_BROADCAST else lines


def boilerplate(docs: DataFrame, threshold: int, min_chars: int, text_col: str, site_col: str) -> DataFrame:
    """The lines (column ``line``) found on at least ``threshold`` sites."""
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("site")
    lines = _found(docs, min_chars, text_col, site)
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS))).alias("sites"))
    likely, _ = store(spread.where(F.col("sites") >= threshold / 2), "lines")
    near = _known(likely.where(F.col("sites") < 2 * threshold).select("line"))
    exact = lines.join(near, "line", "left_semi").distinct().groupBy("line").count().where(F.col("count") >= threshold).select("line")
    return store(likely.where(F.col("sites") >= 2 * threshold).select("line").unionByName(exact), "boilerplate")[0]


def drop_spread_lines(
    docs: DataFrame,
    threshold: int = 10,
    min_chars: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """``docs`` with cleaned text and the columns ``n_lines`` and ``n_removed``."""
    carry = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    names = {c: f"in_{i}" for i, c in enumerate(dict.fromkeys([*carry, id_col, text_col, site_col]))}
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    text = F.col(names[text_col])
    shared = boilerplate(docs, threshold, min_chars, names[text_col], names[site_col])
    found = _found(docs, min_chars, names[text_col], F.col(names[id_col]).alias("_id"))
    gone = found.join(_known(shared), "line", "left_semi").groupBy("_id").agg(F.collect_set("line").alias("_gone"))
    both = docs.join(gone, F.col(names[id_col]).eqNullSafe(F.col("_id")), "left")
    stays = F.filter(_lines(text), lambda x: ~(_counted(x, min_chars) & F.array_contains("_gone", _hash(x))))
    kept = F.when(F.col("_gone").isNull() | text.isNull(), text).otherwise(F.array_join(stays, "\n"))
    n = F.coalesce(F.size(_lines(text)), F.lit(0))
    left = F.when(F.col("_gone").isNull() | text.isNull(), n).otherwise(F.size(stays))
    return both.select(*[(kept if c == text_col else F.col(names[c])).alias(c) for c in carry], n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed"))


#: The same in DuckDB SQL, over ``documents``, with the default parameters.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, source, line, pos, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l),
b AS (
  SELECT t FROM k WHERE length(t) >= 20
  GROUP BY t HAVING count(DISTINCT coalesce('=' || source, '')) >= 10),
m AS (SELECT k.*, b.t IS NOT NULL AS gone FROM k LEFT JOIN b ON k.t = b.t)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT m.gone), '') END AS text,
       count(m.pos) AS n_lines,
       count(m.pos) FILTER (m.gone) AS n_removed
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id
GROUP BY d.doc_id, d.text
"""
