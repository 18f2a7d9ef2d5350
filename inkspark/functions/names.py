"""Paths, names and other short strings of notes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_white(x: Column | str) -> Column:
    """Trim white space as Unicode has it."""
    return F.regexp_replace(c(x), rf"^{WHITE}+|{WHITE}+$", "")


def quoted(text: str) -> str:
    """A Java pattern for exactly this text."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def lines(x: Column | str) -> Column:
    """Lines without their ends; a last line end makes no further line."""
    return F.split(F.regexp_replace(c(x), r"\r?\n\z", ""), r"\r?\n")


def ascii_lower(x: Column | str) -> Column:
    return F.translate(c(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stem(path: Column | str) -> Column:
    """Last segment of a path without a final ``.md``."""
    return F.regexp_replace(c(path), r"^(?:.*/)?([^/]*?)(?:\.md)?$", "$1")


def folder(path: Column | str) -> Column:
    """Everything before the last slash, empty at the root."""
    return F.regexp_replace(c(path), r"/?[^/]*$", "")


def slug(title: Column | str) -> Column:
    """A title as a file stem."""
    clean = trim_white(F.translate(trim_white(title), '/\\:*?"<>|', "---------"))
    return F.when(clean == "", "Untitled").otherwise(clean)


def clean_folder(path: Column | str) -> Column:
    """A folder path without empty, blank or parent segments, each a slug."""
    parts = F.filter(F.transform(F.split(c(path), r"[/\\]"), trim_white), lambda s: (s != "") & (s != ".."))
    return F.array_join(F.transform(parts, slug), "/")


def stays_inside(path: Column | str) -> Column:
    """Whether a relative path cannot leave the folder it is joined to."""
    return ~F.exists(F.split(c(path), r"[/\\]"), lambda s: s == "..") & ~c(path).rlike(r"^[/\\]|^[A-Za-z]:")


def plain_file_name(name: Column | str) -> Column:
    return (c(name) != "") & ~c(name).rlike(r"[/\\]") & ~c(name).startswith(".") & ~c(name).contains("..")


def split_extension(name: Column | str) -> Column:
    """struct(base, ext) at the last dot that is not the first character."""
    has = c(name).rlike(r"(?s)^.+\.[^.]*$")
    return F.struct(
        F.when(has, F.regexp_replace(c(name), r"(?s)\.[^.]*$", "")).otherwise(c(name)).alias("base"),
        F.when(has, F.regexp_extract(c(name), r"\.([^.]*)$", 1)).otherwise("").alias("ext"),
    )


def match_key(x: Column | str) -> Column:
    """Names that differ only in white space or case share a key."""
    return F.lower(trim_white(F.regexp_replace(c(x), rf"{WHITE}+", " ")))


def normal_link(url: Column | str) -> Column:
    return F.lower(F.regexp_replace(trim_white(url), "/+$", ""))


def normal_base(url: Column | str) -> Column:
    """A site address with a scheme (https if it has none) and no closing slash."""
    bare = F.regexp_replace(trim_white(url), "/+$", "")
    return F.when(bare.rlike("(?i)^https?://"), F.regexp_replace(bare, "(?i)^(http|https)://", "$1://")).otherwise(F.concat(F.lit("https://"), bare))


def url_segment(x: Column | str) -> Column:
    """Percent-encoding that keeps letters, digits and ``-._~``."""
    return F.replace(F.replace(F.replace(F.url_encode(c(x)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def join_url(base: Column | str, path: Column | str) -> Column:
    return F.concat(F.regexp_replace(c(base), "/+$", ""), F.lit("/"), F.array_join(F.transform(F.filter(F.split(c(path), "/"), lambda s: s != ""), url_segment), "/"))


def percent_decode(x: Column | str) -> Column:
    return F.url_decode(F.replace(c(x), F.lit("+"), F.lit("%2B")))


def url_path(url: Column | str) -> Column:
    return F.coalesce(F.try_parse_url(c(url), F.lit("PATH")), F.lit(""))


def remote_notes(xml: Column | str, root: Column | str) -> Column:
    """Relative paths of the markdown files that a multistatus answer lists, sorted and distinct."""
    hrefs = F.regexp_extract_all(c(xml), F.lit(r"(?is)<(?:[a-z0-9]+:)?href[^>]*>([^<]*)"), F.lit(1))
    base = F.concat(F.regexp_replace(percent_decode(root), "/+$", ""), F.lit("/"))
    paths = F.transform(hrefs, lambda h: percent_decode(F.regexp_replace(trim_white(h), r"(?i)^https?://[^/]*", "")))
    inside = F.filter(paths, lambda p: p.startswith(base) & F.lower(p).endswith(".md"))
    return F.array_sort(F.array_distinct(F.transform(inside, lambda p: F.substr(p, F.length(base) + 1))))


def basic_auth(user: Column | str, password: Column | str) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.encode(F.concat(c(user), F.lit(":"), c(password)), "UTF-8")))


def djb2(x: Column | str) -> Column:
    """The 64-bit wrapping hash h = h * 33 + byte from 5381, as a decimal string."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(c(x), "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("decimal(20,0)"))
    whole = F.lit("18446744073709551616").cast("decimal(20,0)")
    step = F.aggregate(codes, F.lit(5381).cast("decimal(20,0)"), lambda h, b: ((h * 33 + b).cast("decimal(38,0)") % whole).cast("decimal(20,0)"))
    return step.cast("string")


def template(text: Column | str, title: Column | str, now: Column) -> Column:
    """Fill ``{{date}} {{time}} {{title}} {{weekday}} {{month}} {{year}}``; other names stay."""
    out = c(text)
    values = {"date": F.date_format(now, "yyyy-MM-dd"), "time": F.date_format(now, "HH:mm"), "weekday": F.date_format(now, "EEEE"), "month": F.date_format(now, "MMMM"), "year": F.date_format(now, "yyyy"), "title": c(title)}
    for name, value in values.items():
        safe = F.regexp_replace(value, r"([\\$])", r"\\$1")
        out = F.regexp_replace(out, F.lit(rf"(?i)\{{\{{\s*{name}\s*\}}\}}"), safe)
    return out


def capture_line(at: Column, text: Column | str) -> Column:
    return F.concat(F.lit("- "), F.date_format(at, "HH:mm"), F.lit(" "), trim_white(text))


def appended(content: Column | str, text: Column | str) -> Column:
    """Content with a blank line and the text after it."""
    head = F.regexp_replace(c(content), rf"{WHITE}+$", "")
    return F.concat(F.when(head == "", "").otherwise(F.concat(head, F.lit("\n\n"))), trim_white(text), F.lit("\n"))


def link_markup(name: Column | str, shown: Column | str) -> Column:
    """``[[name]]``, or with the shown text where that differs by more than case."""
    plain = F.lower(trim_white(shown)).isin("") | (F.lower(trim_white(shown)) == F.lower(c(name)))
    return F.concat(F.lit("[["), c(name), F.when(plain, "").otherwise(F.concat(F.lit("|"), c(shown))), F.lit("]]"))


def link_cell(cell: Column | str) -> Column:
    """struct(target, label) of a cell that is exactly one link, else null."""
    whole = r"^\[\[([^\]|]+)(?:\|([^\]]+))?\]\]$"
    target = F.regexp_extract(c(cell), whole, 1)
    label = F.regexp_extract(c(cell), whole, 2)
    return F.when(c(cell).rlike(whole), F.struct(target.alias("target"), F.when(label == "", target).otherwise(label).alias("label")))


def size_label(n: Column | str) -> Column:
    """Bytes in B below 1024, else kB with one decimal."""
    n = c(n)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", n / 1024), F.lit(" kB")))


#: Clients whose names have a spelling of their own, and the patterns of a date by language.
CLIENTS = ["Codex", "Claude"]
SHORT_DATES = {"de": "dd.MM., HH:mm", "": "dd/MM, HH:mm"}


def client_label(client: Column | str) -> Column:
    """How an assistant's client is shown: ``AI`` where none is named, known ones in their own spelling."""
    shown = F.when(F.coalesce(c(client), F.lit("")) == "", "AI")
    for name in CLIENTS:
        shown = shown.when(F.lower(c(client)) == name.lower(), name)
    return shown.otherwise(c(client))


def when_label(ms: Column | str, lang: str) -> Column:
    """Day, month and time of milliseconds in the session's time zone, as the language writes them."""
    return F.date_format(F.timestamp_millis(c(ms)), SHORT_DATES.get(lang, SHORT_DATES[""]))


def radius(in_links: Column | str) -> Column:
    """Size tier of a node by its distinct incoming links."""
    n = c(in_links)
    # Tiers from 0, 1, 3, 8 and 20 links.
    return F.when(n >= 20, 8.5).when(n >= 8, 6.75).when(n >= 3, 5.25).when(n >= 1, 4.0).otherwise(3.0)


def palette_score(label: Column | str, query: str) -> Column:
    """Rank of a label for a typed query; null where the letters do not occur in order."""
    text, wanted = F.lower(c(label)), query.lower()
    if not wanted:
        return F.lit(0)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("points"), F.lit(True).alias("ok"))

    def step(state: Column, ch: Column) -> Column:
        place = F.call_function("locate", ch, text, state["at"] + 1)
        begins = (place == 1) | F.substr(text, place - 1, F.lit(1)).isin(" ", "/", "-")
        gain = F.when(begins, 6).otherwise(0) + F.when(place == state["at"] + 1, 3).otherwise(1)
        hit = state["ok"] & (place > 0)
        return F.struct(F.when(hit, place).otherwise(state["at"]).alias("at"), (state["points"] + F.when(hit, gain).otherwise(0)).alias("points"), hit.alias("ok"))

    end = F.aggregate(F.array(*[F.lit(ch) for ch in wanted]), start, step, lambda s: F.when(s["ok"], s["points"]))
    return F.when(F.instr(text, wanted) > 0, 1001 - F.instr(text, wanted)).otherwise(end)
