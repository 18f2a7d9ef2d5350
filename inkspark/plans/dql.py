"""The note query language: TABLE/LIST, FROM, WHERE, SORT, LIMIT.

A query text becomes a small dataclass on the driver, and that becomes a
DataFrame; clauses apply in the order FROM, WHERE, SORT, LIMIT whatever their
order in the text. Mistakes are results of kind ``error`` with a stable code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.names import stem
from ..lineage import cut

# Error codes that callers rely on.
UNSUPPORTED, NO_COLUMNS = "unsupported_query", "table_columns_required"
NO_COMPARISON, NO_SORT_FIELD = "where_comparison_required", "sort_field_required"

#: The first of these that occurs anywhere in a condition is its operator.
OPERATORS = (">=", "<=", "!=", "=", ">", "<")
CLAUSE = re.compile(r"(?:from|where|sort|limit) ", re.IGNORECASE | re.ASCII)
EPSILON = 2.220446049250313e-16


class QueryError(ValueError):
    """Carries one of the codes above."""


@dataclass(frozen=True)
class Query:
    kind: str
    columns: tuple[tuple[str, str], ...] = ()
    source: tuple[str, str] | None = None
    where: tuple[str, str, str] | None = None
    sort: tuple[str, bool] | None = None
    limit: int | None = None


@dataclass
class Result:
    """What a query gives: ``frame`` has ``row`` (array of strings) or ``item``."""

    kind: str
    columns: list[str] = field(default_factory=list)
    frame: DataFrame | None = None
    error: str | None = None


def _clause_starts(text: str) -> list[int]:
    """Places outside quotes where a clause keyword stands as a word of its own."""
    starts, quote = [], ""
    for i, ch in enumerate(text):
        if ch in "\"'":
            quote = "" if quote == ch else quote or ch
        elif not quote and (i == 0 or text[i - 1].isspace()) and CLAUSE.match(text, i):
            starts.append(i)
    return starts


def _value(text: str) -> str:
    bare = text.strip().strip('"').strip("'").strip()
    if bare.startswith("[") and bare.endswith("]"):
        items = (v.strip().strip('"').strip("'") for v in bare[1:-1].split(","))
        return ", ".join(v for v in items if v)
    return bare


def _source(text: str) -> tuple[str, str] | None:
    """A tag or a folder; anything else is no restriction."""
    if text.startswith("#") and text[1:].split():
        name = text[1:].split()[0].strip(",").strip("#")
        if name:
            return "tag", re.sub("[A-Z]", lambda m: m[0].lower(), name)
    quoted = re.match(r'"([^"]*)"', text)
    return ("folder", quoted[1].strip("/")) if quoted else None


def _condition(text: str) -> tuple[str, str, str]:
    for op in OPERATORS:
        left, found, right = text.partition(op)
        if found:
            return left.strip(), op, _value(right)
    raise QueryError(NO_COMPARISON)


def _order(text: str) -> tuple[str, bool]:
    parts = text.split()
    if not parts:
        raise QueryError(NO_SORT_FIELD)
    way = parts[-1].lower() if parts[-1].lower() in ("asc", "desc") else ""
    return " ".join(parts[:-1] if way else parts), way == "desc"


def _column(text: str) -> tuple[str, str]:
    """(field, label) of one column."""
    text = text.strip()
    left, found, right = (text[: m.start()], True, text[m.end() :]) if (m := re.search(" as ", text, re.IGNORECASE)) else (text, False, text)
    return left.strip(), right.strip().strip('"') if found else text


def parse(text: str) -> Query:
    """Read a query; clause mistakes are reported before those of the first words."""
    head, found = "", {}
    for line in filter(None, map(str.strip, text.splitlines())):
        starts = _clause_starts(line)
        if not head:
            cut = starts[0] if starts else len(line)
            head, line = line[:cut].strip(), line[cut:]
            starts = [s - cut for s in starts]
        elif starts[:1] != [0]:
            continue
        for a, b in zip(starts, [*starts[1:], len(line)]):
            word, _, body = line[a:b].partition(" ")
            body = body.strip()
            match word.lower():
                case "from":
                    found["source"] = _source(body)
                case "where":
                    found["where"] = _condition(body)
                case "sort":
                    found["sort"] = _order(body)
                case "limit":
                    found["limit"] = int(body) if re.fullmatch(r"\+?[0-9]+", body, re.ASCII) else None
    word, blank, rest = head.partition(" ")
    if word.lower() == "table" and blank:
        columns = tuple(c for c in map(_column, rest.split(",")) if c[0])
        if not columns:
            raise QueryError(NO_COLUMNS)
        return Query("table", columns, **found)
    if word.lower() == "list":
        return Query("list", ((rest.strip(), rest.strip()),) if blank else (), **found)
    raise QueryError(UNSUPPORTED)


#: Fields that follow from a note's path; the title is read from its text.
OF_PATH = ("file.name", "file.path", "file.link")


def key_of(name: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), name.strip())


def mentioned(query: Query) -> set[str]:
    """Keys of all fields that a query reads."""
    names = [f for f, _ in query.columns] + [x[0] for x in (query.where, query.sort) if x]
    return {key_of(n) for n in names}


def true_of_nothing(op: str, wanted: str) -> bool:
    """Whether a condition holds where the field is missing."""
    other = wanted.lower()
    return {"=": other == "", "!=": other != "", ">": False, ">=": other == "", "<": other != "", "<=": True}[op]


def _candidates(notes: DataFrame, query: Query) -> DataFrame:
    """Notes whose text holds the words without which a query's tag or condition cannot hold."""
    low = F.lower("content")
    if query.source and query.source[0] == "tag":
        notes = notes.where(low.contains(query.source[1].lower()))
    if query.where and not true_of_nothing(*query.where[1:]) and (key := key_of(query.where[0])) not in (*OF_PATH, "title"):
        notes = notes.where(low.contains(key.lower()))
    return notes


def pages(notes: DataFrame, query: Query | None = None) -> DataFrame:
    """path, title, fields (map) and tags (array) of every note.

    With a query, only the notes that it may choose are read, and only what it
    reads of them: the fields that it names, and the title or the tags where
    they matter. Each step is a projection of its own, so that what several
    later ones need is computed once for each note. The last one passes a
    one-row generator: conditions on fields would otherwise be pushed below it
    with a copy of the whole reading for each mention of a field. Conditions on
    the path still reach the scan.
    """
    if query is not None:
        notes = _candidates(notes, query)
    keys = None if query is None else tuple(sorted(mentioned(query) - {*OF_PATH, "title"}))
    named = query is None or "title" in mentioned(query)
    tagged = query is None or bool(query.source and query.source[0] == "tag")
    title, parts, pairs, inline, own, tags, row = _reading(id(SparkContext._gateway), keys, named, tagged)
    read = notes.select("path", title, parts).select("path", "title", "parts", pairs, inline)
    return read.select("path", "title", own, tags).select("path", row)


@lru_cache(maxsize=256)
def _reading(gateway: int, keys: tuple[str, ...] | None, named: bool, tagged: bool) -> tuple[SparkColumn, ...]:
    """The expressions of ``pages``; building them costs more than reading a small vault, so they are kept."""
    title = md.title("path", "content") if named else F.lit(None).cast("string")
    tags = md.tags(F.col("pairs"), F.col("parts.body")) if tagged else F.array().cast("array<string>")
    if keys is None:
        own = md.fields(F.col("pairs"), F.col("inline"))
        builtin = {"file.name": stem("path"), "file.path": F.col("path"), "file.link": F.concat(F.lit("[["), stem("path"), F.lit("]]")), "title": F.col("title")}
        given = F.create_map(*[x for k, v in builtin.items() for x in (F.lit(k), v)])
        merged = F.map_concat(F.map_filter(given, lambda k, _: ~F.map_contains_key("own", k)), F.col("own"))
    else:
        own = md.entries(F.col("pairs"), F.col("inline")) if keys else F.lit(None)
        merged = F.create_map(*[x for k in keys for x in (F.lit(k), md.field("own", k))]).cast("map<string,string>")
    return (
        title.alias("title"), md.front_and_body("content").alias("parts"), md.front_fields(F.col("parts.front")).alias("pairs"), md.inline_part(F.col("parts.body")).alias("inline"),
        own.alias("own"), tags.alias("tags"), F.inline(F.array(F.struct("title", merged.alias("fields"), "tags"))),
    )


def value_of(name: str) -> SparkColumn:
    """A field of a page; the computed ones cannot be overridden and a missing one is empty."""
    key = key_of(name)
    match key:
        case "file.name":
            return stem("path")
        case "file.path":
            return F.col("path")
        case "file.link":
            return F.concat(F.lit("[["), stem("path"), F.lit("]]"))
        case "title":
            return F.col("title")
    return F.coalesce(F.try_element_at("fields", F.lit(key)), F.lit(""))


def _from(source: tuple[str, str]) -> SparkColumn:
    kind, name = source
    if kind == "tag":
        return F.exists("tags", lambda t: (t == name) | t.startswith(name + "/"))
    return F.lit(True) if not name else (F.col("path") == name) | F.col("path").startswith(name + "/")


def _where(name: str, op: str, wanted: str) -> SparkColumn:
    """Numbers where both sides are numbers, else lower-cased text."""
    actual = value_of(name)
    x, y = md.number(actual), md.number(F.lit(wanted))
    nan = F.isnan(x) | F.isnan(y)
    near = F.abs(x - y) < EPSILON
    numeric = {"=": near, "!=": F.abs(x - y) >= EPSILON, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
    a, b = F.lower(actual), F.lit(wanted.lower())
    text = {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    infinite = F.isnan(x - y)  # equal infinities are neither equal nor unequal
    numeric = numeric & ~nan & (F.lit(op not in ("=", "!=")) | ~infinite)
    return F.when(x.isNotNull() & y.isNotNull(), numeric).otherwise(text)


def _sorted(frame: DataFrame, name: str, down: bool) -> DataFrame:
    """Missing values, then numbers, then text; ties by path."""
    v = value_of(name)
    keys = [F.when(v == "", 0).when(md.number(v).isNotNull(), 1).otherwise(2), md.number(v), F.lower(v)]
    return frame.orderBy(*[k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys], "path")


def plan(pages_frame: DataFrame, query: Query) -> DataFrame:
    """The chosen pages of a query, in order."""
    frame = pages_frame
    if query.source:
        frame = frame.where(_from(query.source))
    if query.where:
        frame = frame.where(_where(*query.where))
    if query.sort:
        # a sort of everything looks at its input twice; what is left of it by now is small
        frame = _sorted(cut(frame) if query.limit is None else frame, *query.sort)
    elif query.limit is not None:
        frame = frame.orderBy("path")
    return frame if query.limit is None else frame.limit(query.limit)


def run(notes: DataFrame, text: str) -> Result:
    """Answer a query text over a table of notes (path, content)."""
    try:
        query = parse(text)
    except QueryError as mistake:
        return Result("error", error=str(mistake))
    return answer(pages(notes, query), query)


def answer(pages_frame: DataFrame, query: Query) -> Result:
    """The result of a query over pages."""
    frame = plan(pages_frame, query)
    if query.kind == "table":
        return Result("table", [label for _, label in query.columns], frame.select("path", F.array(*[value_of(f) for f, _ in query.columns]).alias("row")))
    link = F.concat(F.lit("[["), stem("path"), F.lit("]]"))
    item = F.when(value_of(query.columns[0][0]) != "", value_of(query.columns[0][0])).otherwise(link) if query.columns else link
    return Result("list", frame=frame.select("path", item.alias("item")))
