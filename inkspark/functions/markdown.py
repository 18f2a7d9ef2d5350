"""What a note's text says: titles, frontmatter, inline fields, tags, links, terms.

Several parts of the system split frontmatter by rules of their own; each rule
has its own function here and they are not unified.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import WHITE, ascii_lower, c, lines, quoted, stem, trim_white

WORD_SIGN = r"[\p{IsAlphabetic}\p{N}_]"

# Words too common to compare notes by, German and English.
COMMON_WORDS = (
    "aber alle als also am an auch auf aus bei bin bis das dass dem den der des die dies diese doch dort du ein "
    "eine einem einen einer eines er es für hat hatte ich ihr im in ist kann man mehr mit nach nicht noch nur oder "
    "sein sich sie sind über um und uns unter von vor war wenn werden wie wir wird zu zum zur about all and any "
    "are been but can for from has have how if into its may more not our out she than that the their them then there "
    "these they this were what when which who will with you your"
).split()
# Words that do not count as significant terms.
MINOR_WORDS = (
    "the a an and or but of to in on for with is are was were be this that it as at by from into über und "
    "oder der die das ein eine ist im zu mit auf den dem"
).split()
# A number as the query language reads it; blanks and suffixes make it text.
NUMBER = r"^[+-]?(?:(?i:inf|infinity|nan)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"


# --- titles and authorship -------------------------------------------------


def split_front(content: Column | str) -> Column:
    """struct(front, body): the leading block with its fences, and the text without the line ends before it.

    A text that does not begin with ``---``, or whose block is never closed, is all body.
    """
    front = F.regexp_extract(c(content), r"\A(---(?s:.*?)\n---[^\n]*\n?)", 1)
    rest = F.regexp_replace(F.substr(c(content), F.length(front) + 1), r"\A\n+", "")
    return F.struct(front.alias("front"), F.when(front == "", c(content)).otherwise(rest).alias("body"))


def join_front(front: Column | str, body: Column | str) -> Column:
    """A body below its block, with one blank line between; the body alone without one."""
    kept = F.regexp_replace(c(front), rf"{WHITE}+\z", "")
    return F.when(c(front) == "", c(body)).otherwise(F.concat(kept, F.lit("\n\n"), c(body)))


def unescaped_links(content: Column | str) -> Column:
    """Text in which an editor's backslashes before the brackets of links are taken away, and no others."""
    return F.replace(F.replace(c(content), F.lit(r"\[\["), F.lit("[[")), F.lit(r"\]\]"), F.lit("]]"))


def heading(content: Column | str) -> Column:
    """First line of text after a leading frontmatter block, without markers; null if there is none.

    A block that is never closed takes the whole text.
    """
    fence = rf"(?:{WHITE}(?<!\n))*"
    opens = c(content).rlike(rf"^---{fence}(?:\n|\z)")
    after = F.when(opens, F.regexp_extract(c(content), rf"(?s)^---{fence}\n(?:.*?\n)?---{fence}(?:\n|\z)(.*)$", 1)).otherwise(c(content))
    line = F.regexp_extract(after, rf"(?dm)^(?:{WHITE}(?<!\n))*+#*+[>*\-]*+(?:{WHITE}(?<!\n))*+([^\n]+)", 1)
    return F.nullif(F.substring(trim_white(line), 1, 120), F.lit(""))


def title(path: Column | str, content: Column | str) -> Column:
    """Display title: the heading, or the stem where that is missing or a bare placeholder."""
    head = heading(content)
    return F.coalesce(F.when(~(head.startswith("{{") & head.endswith("}}")), head), stem(path))


def front_value(content: Column | str, key: str) -> Column:
    """First value of a frontmatter key, in any case; null without one."""
    after = F.regexp_extract(F.regexp_replace(c(content), rf"^{WHITE}+", ""), r"(?s)^---(.*?)\n---", 1)
    found = F.filter(lines(after), lambda x: F.lower(trim_white(x)).startswith(f"{key}:"))
    return trim_white(F.regexp_replace(F.get(found, F.lit(0)), r"^[^:]*:", ""))


def is_ai(content: Column | str) -> Column:
    return F.coalesce(F.lower(front_value(content, "author")).isin("ai", '"ai"', "'ai'"), F.lit(False))


def ai_client(content: Column | str) -> Column:
    bare = F.regexp_replace(front_value(content, "ai_client"), "^[\"']+|[\"']+$", "")
    return F.when(bare != "", bare)


def ai_stamp(content: Column | str, client: str | None = None) -> Column:
    """Content marked as written by an assistant: old marks go, new ones close the frontmatter."""
    name = (client or "").strip()
    ok = bool(name) and all(ch.isascii() and (ch.isalnum() or ch in "-_") for ch in name)
    marks = ["author: ai", *([f"ai_client: {name}"] if ok else [])]
    text = F.regexp_replace(c(content), r"^\x{FEFF}+", "")
    pattern = r"(?s)^---(.*?)(\n---.*)$"
    front, rest = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    kept = F.filter(F.when(front == "", F.array().cast("array<string>")).otherwise(lines(front)), lambda x: ~F.lower(x).rlike(rf"^{WHITE}*(?:author|ai_client):"))
    stamped = F.concat(F.lit("---"), F.array_join(F.concat(kept, F.array(*map(F.lit, marks))), "\n"), rest)
    fresh = F.concat(F.lit("---\n" + "\n".join(marks) + "\n---\n\n"), c(content))
    return F.when(text.rlike(pattern), stamped).otherwise(fresh)


def is_imported(content: Column | str) -> Column:
    """Whether the frontmatter says that an import made the note."""
    front = F.regexp_extract(c(content), r"(?s)^---\n(.*?)\n---", 1)
    return F.exists(lines(front), lambda x: trim_white(x) == "source: import")


# --- fields and tags of the query language ---------------------------------


def front_and_body(content: Column | str) -> Column:
    """struct(front, body): the block from a leading ``---`` to the first line that begins with it."""
    at = F.locate("\n---", c(content), 4)
    has = c(content).startswith("---") & (at > 0)
    rest = F.substr(c(content), at + 4)
    return F.struct(
        F.when(has, F.substr(c(content), F.lit(4), at - 4)).otherwise("").alias("front"),
        F.when(has, F.when(rest.startswith("\n"), F.substr(rest, F.lit(2))).otherwise(rest)).otherwise(c(content)).alias("body"),
    )


def clean_value(x: Column | str) -> Column:
    """A value without outer quotes; an inline list as its items, joined by commas."""

    def bare(v: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(v, '^"+|"+$', ""), "^'+|'+$", "")

    whole = trim_white(bare(trim_white(x)))
    items = F.filter(F.transform(F.split(F.substr(whole, F.lit(2), F.greatest(F.length(whole) - 2, F.lit(0))), ","), lambda v: bare(trim_white(v))), lambda v: v != "")
    return F.when(whole.rlike(r"(?s)^\[.*\]$"), F.array_join(items, ", ")).otherwise(whole)


def clean_tag(x: Column) -> Column:
    return ascii_lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(trim_white(x), "^#+", ""), '^"+|"+$', ""), "^'+|'+$", ""))


def front_fields(front: Column) -> Column:
    """array<struct(key, value, item)> of a frontmatter block, in order.

    ``item`` marks an entry of a block list, which adds to its key's value.
    """
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<struct<key:string,value:string,item:boolean>>").alias("out"))

    def entry(key: Column, value: Column, item: bool) -> Column:
        return F.array(F.struct(key.alias("key"), value.alias("value"), F.lit(item).alias("item")))

    def step(state: Column, line: Column) -> Column:
        key = ascii_lower(trim_white(F.regexp_extract(line, r"(?s)^([^:]*):", 1)))
        value = trim_white(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
        listed = state["open"].isNotNull() & line.startswith("-")
        pair = line.contains(":")
        return F.struct(
            F.when(listed, state["open"]).when(pair & (value == ""), key).alias("open"),
            F.when(listed, F.concat(state["out"], entry(state["open"], clean_value(F.substr(line, F.lit(2))), True)))
            .when(pair & (value != ""), F.concat(state["out"], entry(key, clean_value(value), False)))
            .otherwise(state["out"])
            .alias("out"),
        )

    trimmed = F.filter(F.transform(lines(front), trim_white), lambda x: x != "")
    return F.aggregate(trimmed, start, step, lambda s: s["out"])


# An inline field, and a tag in a body.
INLINE = r"(?dmU)(?:^|\[|\s)([A-Za-z][A-Za-z0-9 _-]{0,60})::\s*([^\]\n]+)"
TAG = r"(?U)(?:^|\s)#([A-Za-z0-9_/-]+)"


def inline_part(body: Column) -> Column:
    """The lines of a body that hold inline fields, with a value that stands on the next line."""
    found = F.array_join(F.regexp_extract_all(body, F.lit(r"(?dmU)^[^\n]*::\s*[^\]\n]+"), F.lit(0)), "\n")
    return F.when(body.contains("::"), found).otherwise("")


def entries(pairs: Column, inline: Column) -> Column:
    """array<struct(key, value, item)> from ``front_fields`` and ``inline_part``, in order."""
    found = F.arrays_zip(
        F.transform(F.regexp_extract_all(inline, F.lit(INLINE), F.lit(1)), lambda k: ascii_lower(trim_white(k))).alias("key"),
        F.transform(F.regexp_extract_all(inline, F.lit(INLINE), F.lit(2)), lambda v: clean_value(trim_white(v))).alias("value"),
    )
    good = F.filter(found, lambda e: (e["key"] != "") & (e["value"] != ""))
    both = F.concat(pairs, F.transform(good, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit(False).alias("item"))))
    return F.when(inline == "", pairs).otherwise(both)


def _joined(old: Column, e: Column) -> Column:
    """A field's value after one more entry: items of a list add up, others replace."""
    return F.when(e["item"] & old.isNotNull() & (old != ""), F.concat(old, F.lit(", "), e["value"])).otherwise(e["value"])


def field(found: Column | str, key: str) -> Column:
    """Value of one field from ``entries``; null without it."""
    return F.aggregate(F.filter(c(found), lambda e: e["key"] == key), F.lit(None).cast("string"), _joined)


def fields(pairs: Column, inline: Column) -> Column:
    """map<string,string> from ``front_fields`` and ``inline_part``; later ones win."""

    def fold(acc: Column, e: Column) -> Column:
        value = _joined(F.try_element_at(acc, e["key"]), e)
        return F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.create_map(e["key"], value))

    return F.aggregate(entries(pairs, inline), F.create_map().cast("map<string,string>"), fold)


def tags(pairs: Column, body: Column) -> Column:
    """Sorted distinct tags from ``front_fields`` and the body."""
    front = F.filter(pairs, lambda e: e["key"] == "tags")
    listed = F.flatten(F.transform(front, lambda e: F.when(e["item"], F.array(e["value"])).otherwise(F.split(e["value"], ","))))
    inside = F.when(body.contains("#"), F.regexp_extract_all(body, F.lit(TAG), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(listed, inside), clean_tag), lambda t: t != "")))


def number(x: Column) -> Column:
    """The value as a double where the query language reads a number, else null."""
    return F.when(x.rlike(NUMBER), F.regexp_replace(x, "^\\+", "").try_cast("double"))


# --- links -----------------------------------------------------------------


def links(content: Column | str) -> Column:
    """Targets of all ``[[...]]`` spans in order, without alias or anchor."""
    plain = F.replace(F.replace(c(content), F.lit("\\["), F.lit("[")), F.lit("\\]"), F.lit("]"))
    inner = F.regexp_extract_all(plain, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    return F.filter(F.transform(inner, lambda x: trim_white(F.regexp_extract(x, r"(?s)^([^|#^]*)", 1))), lambda x: x != "")


def _closed(content: Column) -> Column:
    """The text before a link that is never closed."""
    return F.regexp_replace(content, r"(?s)\[\[(?!.*?\]\]).*$", "")


def _pieces(closed: Column) -> Column:
    """Link spans and the text between them, in order."""
    return F.regexp_extract_all(closed, F.lit(r"(?s)\[\[.*?\]\]|[^\[]+|\["), F.lit(0))


def without_links(content: Column | str) -> Column:
    """Link spans as blanks; an unclosed one takes the rest of the text."""
    blank = F.transform(_pieces(_closed(c(content))), lambda p: F.when(p.startswith("[["), F.repeat(F.lit(" "), F.octet_length(p))).otherwise(p))
    return F.array_join(blank, "")


def retarget(content: Column | str, old: str, new: str) -> Column:
    """Links to ``old`` (ASCII case aside) lead to ``new``; alias and anchor stay."""
    safe = new.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c(content), rf"(?i)\[\[\s*{quoted(old)}\s*([|#^][^\]]*)?\]\]", f"[[{safe}$1]]")


def mention_pattern(name: str) -> str:
    return rf"(?iu)(?<!{WORD_SIGN}){quoted(name)}(?!{WORD_SIGN})"


def mentions(text: Column | str, name: str) -> Column:
    """Whole-word occurrences of a name, in any case."""
    return F.regexp_count(c(text), F.lit(mention_pattern(name))) if name else F.lit(0)


def link_mentions(content: Column | str, name: str) -> Column:
    """struct(content, n): whole-word mentions outside links become links in their own spelling.

    Text is cut into links and the pieces between them; what follows an
    unclosed link stays as it is.
    """
    closed = _closed(c(content))
    tail = F.substr(c(content), F.length(closed) + 1)
    pattern = mention_pattern(name)
    linked = F.transform(_pieces(closed), lambda p: F.when(p.startswith("[["), p).otherwise(F.regexp_replace(p, pattern, "[[$0]]")))
    counts = F.transform(_pieces(closed), lambda p: F.when(p.startswith("[["), 0).otherwise(F.regexp_count(p, F.lit(pattern))))
    return F.struct(F.concat(F.array_join(linked, ""), tail).alias("content"), F.aggregate(counts, F.lit(0), lambda a, b: a + b).alias("n"))


# --- search ----------------------------------------------------------------


def window(content: Column, at: Column, size: Column) -> Column:
    """Snippet around ``size`` characters at the 1-based place ``at``."""
    begin = F.greatest(at - 30, F.lit(1))
    return F.concat(F.lit("…"), trim_white(F.replace(F.substr(content, begin, size + 70), F.lit("\n"), F.lit(" "))), F.lit("…"))


def first_text_line(content: Column) -> Column:
    return F.coalesce(F.get(lines(content), F.lit(0)), F.lit(""))


def snippet(content: Column | str, needle: str) -> Column:
    """Snippet around the first occurrence in any case; else the first line."""
    at = F.locate(needle.lower(), F.lower(c(content)))
    return F.when(at > 0, window(c(content), at, F.lit(len(needle)))).otherwise(first_text_line(c(content)))


def regex_snippet(content: Column | str, pattern: str) -> Column:
    hit = F.regexp_substr(c(content), F.lit(pattern))
    at = F.regexp_instr(c(content), F.lit(pattern))
    return F.when(hit.isNotNull(), window(c(content), at, F.greatest(F.length(hit), F.lit(1)))).otherwise(first_text_line(c(content)))


def first_line(content: Column | str) -> Column:
    """First line with content, without heading marks, at most 80 characters."""
    bare = F.transform(lines(content), lambda x: trim_white(F.regexp_replace(x, "^#+", "")))
    return F.coalesce(F.substring(F.get(F.filter(bare, lambda x: (x != "") & (x != "---")), F.lit(0)), 1, 80), F.lit(""))


# --- terms -----------------------------------------------------------------


def terms(text: Column | str) -> Column:
    """Comparable words, repeats kept: three characters or more, lower case, not common."""
    found = F.transform(F.regexp_extract_all(c(text), F.lit(WORD_SIGN + "+"), F.lit(0)), F.lower)
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*COMMON_WORDS))


def significant_terms(text: Column | str) -> Column:
    """Distinct words of three bytes or more, lower case, not minor."""
    found = F.transform(F.regexp_extract_all(c(text), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*MINOR_WORDS)))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient over character pairs, as multisets."""

    def pairs(x: Column) -> Column:
        return F.when(F.length(x) >= 2, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))

    pa, pb = pairs(a), pairs(b)
    common = F.aggregate(
        F.array_distinct(pa),
        F.lit(0),
        lambda n, g: n + F.least(F.size(F.filter(pa, lambda x: x == g)), F.size(F.filter(pb, lambda x: x == g))),
    )
    total = F.size(pa) + F.size(pb)
    return F.when(a == b, 1.0).when((F.size(pa) == 0) | (F.size(pb) == 0), 0.0).otherwise(2.0 * common / total)
