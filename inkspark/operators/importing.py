"""Blog posts into linked notes: HTML to markdown, posts from JSON or RSS, hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown as md
from ..functions.names import c, match_key, normal_link, slug, stem, trim_white
from .rewrite import unique_stems

# Named entities in the order in which they are decoded.
ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"),
    ("&apos;", "'"), ("&nbsp;", " "), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"), ("&szlig;", "ß"),
)
# Markup before block quotes, and after them, with what replaces it.
BEFORE_QUOTES = (
    (r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", ""),
    (r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)"),
    (r"""(?is)<img\b(?=(?:[^>]*?alt\s*=\s*["']([^"'>]*)["'])?)(?=(?:[^>]*?src\s*=\s*["']([^"'>]*)["'])?)[^>]*>""", "![$1]($2)"),
    (r"(?is)<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)>", "**$1**"),
    (r"(?is)<(?:em|i)\b[^>]*>(.*?)</(?:em|i)>", "*$1*"),
    (r"(?is)<code\b[^>]*>(.*?)</code>", "`$1`"),
    *((rf"(?is)<h{i}\b[^>]*>(.*?)</h{i}>", "\n\n" + "#" * i + " $1\n\n") for i in range(1, 7)),
)
AFTER_QUOTES = (
    (r"(?is)<li\b[^>]*>(.*?)</li>", "- $1\n"),
    (r"(?is)</?(?:ul|ol)\b[^>]*>", "\n"),
    (r"(?is)<p\b[^>]*>(.*?)</p>", "\n\n$1\n\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?is)<[^>]+>", ""),
)
TIDY = ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"))
QUOTE = r"(?is)<blockquote\b[^>]*>(.*?)</blockquote>"
#: Marks around the block that the import keeps inside a note of somebody else's.
BLOCK_START, BLOCK_END = "<!-- imported-start -->", "<!-- imported-end -->"

TERM = T.ArrayType(T.ArrayType(T.StructType().add("taxonomy", "string").add("name", "string")))
POST_JSON = (
    T.StructType()
    .add("title", T.StructType().add("rendered", "string"))
    .add("content", T.StructType().add("rendered", "string"))
    .add("link", "string")
    .add("date", "string")
    .add("author", "long")
    .add("_embedded", T.StructType().add("author", T.ArrayType(T.StructType().add("name", "string"))).add("wp:term", TERM))
)


def without_tags(x: Column | str) -> Column:
    return F.regexp_replace(c(x), r"(?is)<[^>]+>", "")


def attribute(tag: Column | str, name: str) -> Column:
    return F.regexp_extract(c(tag), rf"""(?is){name}\s*=\s*["']([^"']*)["']""", 1)


def decoded(x: Column | str) -> Column:
    """Named entities, then decimal ones; a code that is no character vanishes."""
    out = c(x)
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    numbers = F.array_distinct(F.regexp_extract_all(out, F.lit(r"&#(\d+);"), F.lit(1)))

    def sign_of(number: Column) -> Column:
        code = number.try_cast("long")
        valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")

    numeric = F.aggregate(numbers, out, lambda text, n: F.replace(text, F.concat(F.lit("&#"), n, F.lit(";")), sign_of(n)))
    return F.when(out.contains("&#"), numeric).otherwise(out)


def to_markdown(html: Column | str) -> Column:
    """HTML as markdown; unknown tags go and their text stays."""
    s = c(html)
    for pattern, to in BEFORE_QUOTES:
        s = F.regexp_replace(s, pattern, to)
    inner = F.regexp_extract_all(s, F.lit(QUOTE), F.lit(1))
    around = F.split(s, QUOTE)
    lines = F.transform(inner, lambda q: F.array_join(F.transform(F.split(F.regexp_replace(without_tags(q), r"\r?\n\z", ""), r"\r?\n"), lambda x: F.concat(F.lit("> "), trim_white(x))), "\n"))
    quoted = F.transform(lines, lambda q: F.concat(F.lit("\n\n"), q, F.lit("\n\n")))
    joined = F.array_join(F.flatten(F.zip_with(around, quoted, lambda a, q: F.array(a, F.coalesce(q, F.lit(""))))), "")
    s = F.when(F.size(inner) > 0, joined).otherwise(s)
    for pattern, to in AFTER_QUOTES:
        s = F.regexp_replace(s, pattern, to)
    s = decoded(s)
    for pattern, to in TIDY:
        s = F.regexp_replace(s, pattern, to)
    return trim_white(s)


def tag_text(xml: Column | str, tag: str) -> Column:
    """Text of the first element of that name, out of its CDATA."""
    raw = trim_white(F.regexp_extract(c(xml), rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    return decoded(trim_white(F.regexp_replace(raw, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")))


def posts_from_json(rows: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """title, link, date, author, author_id, content_html, categories, tags of each (pos, json)."""
    p = rows.select("pos", F.from_json("json", POST_JSON).alias("p"))
    names = lambda kind: F.filter(F.transform(F.filter(F.flatten(F.coalesce(F.col("p._embedded.`wp:term`"), F.array().cast(TERM))), lambda t: t["taxonomy"] == kind), lambda t: decoded(F.coalesce(t["name"], F.lit("")))), lambda n: n != "")
    own = decoded(F.coalesce(F.get(F.col("p._embedded.author"), F.lit(0))["name"], F.lit("")))
    text = lambda path: F.coalesce(F.col(path), F.lit(""))
    out = p.select(
        "pos", decoded(text("p.title.rendered")).alias("title"), text("p.link").alias("link"), text("p.date").alias("date"), own.alias("own"),
        F.coalesce(F.col("p.author"), F.lit(0)).alias("author_id"), text("p.content.rendered").alias("content_html"), names("category").alias("categories"), names("post_tag").alias("tags"),
    )
    if authors is not None:
        out = out.join(authors.select(F.col("id").alias("author_id"), "name"), "author_id", "left")
    else:
        out = out.withColumn("name", F.lit(None).cast("string"))
    return out.withColumn("author", F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce("name", F.lit("")))).drop("own", "name")


def feed_authors(feeds: DataFrame, posts: DataFrame) -> DataFrame:
    """id, name of authors that an RSS feed names by its items' links."""
    items = feeds.select(F.explode(F.slice(F.split("xml", "<item>"), 2, 1 << 30)).alias("item"))
    named = items.select(normal_link(tag_text("item", "link")).alias("key"), tag_text("item", "dc:creator").alias("name")).where("name <> ''")
    return named.join(posts.select(normal_link("link").alias("key"), F.col("author_id").alias("id")), "key").where("id <> 0").groupBy("id").agg(F.min("name").alias("name"))


def with_block(content: Column | str, block: Column | str) -> Column:
    """Content with its managed block replaced, or the block added at the end."""
    begin, end = F.instr(c(content), BLOCK_START), F.instr(c(content), BLOCK_END)
    inside = F.concat(F.substr(c(content), F.lit(1), begin - 1), c(block), F.substr(c(content), end + len(BLOCK_END)))
    added = F.concat(F.regexp_replace(c(content), r"\s+$", ""), F.lit("\n\n"), c(block), F.lit("\n"))
    return F.when((begin > 0) & (end > begin), inside).otherwise(added)


def terms(posts: DataFrame) -> DataFrame:
    """pos, kind, nth, name, title: every category, tag and author of every post.

    Fixed values: the kinds as hubs name them.
    """
    each = lambda column, kind: posts.select("pos", "title", F.lit(kind).alias("kind"), F.posexplode(column).alias("nth", "name"))
    author = F.when(F.col("author") != "", F.array("author")).otherwise(F.array().cast("array<string>"))
    return each("categories", "Kategorie").unionByName(each("tags", "Tag")).unionByName(each(author, "Autor"))


def existing_keys(notes: DataFrame, titles: Column) -> DataFrame:
    """key -> stem, path: which note answers to a name, by its stem or else by its title."""
    by_stem = notes.select(match_key(stem("path")).alias("key"), F.lit(0).alias("rank"), stem("path").alias("stem"), "path")
    by_title = notes.select(match_key(titles).alias("key"), F.lit(1).alias("rank"), stem("path").alias("stem"), "path")
    best = by_stem.unionByName(by_title).where("key <> ''").groupBy("key").agg(F.min_by(F.struct("stem", "path"), F.struct("rank", "path")).alias("n"))
    return best.select("key", "n.stem", "n.path")


def _answering(notes: DataFrame, posts: DataFrame, author_note: str) -> DataFrame:
    """key -> stem, path of the user's own notes; a chosen note answers to every author."""
    own = existing_keys(notes.where(~md.is_imported("content")), md.title("path", "content"))
    if not author_note.strip():
        return own
    chosen = F.lit(author_note.strip())
    authors = posts.where("author <> ''").select(match_key("author").alias("key")).distinct().select("key", stem(chosen).alias("stem"), chosen.alias("path"))
    return own.join(authors.select("key"), "key", "left_anti").unionByName(authors)


def import_into(notes: DataFrame, posts: DataFrame, folder: str, author_override: str = "", author_note: str = "") -> DataFrame:
    """path, action, content: what an import does to a vault.

    ``write`` makes a post's or a hub's note anew; ``block`` puts the list of a
    hub's posts into the managed block of the user's note that answers to its
    name; ``delete`` takes away a note that an earlier import made and that one
    of the user's notes now stands for. Where several hubs answer to one note
    the last by kind and name has the block.
    """
    posts = posts.withColumn("author", F.lit(author_override.strip())) if author_override.strip() else posts
    known = _answering(notes, posts, author_note)
    made = notes_of(posts, folder, known).select("path", F.lit("write").alias("action"), "content")
    hub = hubs(posts, known).where("exists").withColumn("key", match_key("name")).join(known.select("key", "path"), "key")
    last = hub.groupBy("path").agg(F.max_by(F.struct("name", "titles"), F.struct(_turn("kind"), "name")).alias("h")).select("path", block_text("h.name", "h.titles").alias("block"))
    merged = notes.join(last, "path").select("path", F.lit("block").alias("action"), "content", with_block("content", "block").alias("new"))
    merged = merged.where("new <> content").select("path", "action", F.col("new").alias("content"))
    old = notes.where(md.is_imported("content")).withColumn("key", match_key(stem("path"))).join(known.select("key"), "key", "left_semi")
    gone = old.join(made.select("path"), "path", "left_anti").select("path", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("content"))
    return made.unionByName(merged).unionByName(gone)


def import_report(notes: DataFrame, posts: DataFrame, folder: str, author_override: str = "", author_note: str = "") -> DataFrame:
    """name, path, merged of every author: which note has it, and whether that was there before."""
    posts = posts.withColumn("author", F.lit(author_override.strip())) if author_override.strip() else posts
    known = _answering(notes, posts, author_note).select("key", F.col("path").alias("there"))
    prefix = folder.strip().strip("/")
    made = F.concat(F.lit(prefix + "/" if prefix else ""), slug("author"), F.lit(".md"))
    names = posts.where("author <> ''").select("author").distinct().withColumn("key", match_key("author")).join(known, "key", "left")
    return names.select(F.col("author").alias("name"), F.coalesce("there", made).alias("path"), F.col("there").isNotNull().alias("merged"))


def pages_of_posts(fetch, base: str, size: int = 100, most: int = 50) -> list[str]:
    """JSON texts of a site's pages of posts, by ``fetch(url)``, which gives None where there is no such page.

    Stops at a missing page, at an empty one, and after one that is not full.
    """
    import json

    found: list[str] = []
    for n in range(1, most + 1):
        text = fetch(f"{base}/wp-json/wp/v2/posts?per_page={size}&page={n}&_embed=1")
        rows = json.loads(text) if text else []
        if not isinstance(rows, list) or not rows:
            break
        found += [json.dumps(r, ensure_ascii=False) for r in rows]
        if len(rows) < size:
            break
    return found


def hubs(posts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """kind, name, stem, titles (in post order) and whether a note is there already."""
    grouped = terms(posts).groupBy("kind", "name").agg(F.array_sort(F.collect_list(F.struct("pos", "nth", "title"))).alias("rows"))
    out = grouped.select("kind", "name", F.col("rows.title").alias("titles"), match_key("name").alias("key"))
    if existing is None:
        return out.select("kind", "name", slug("name").alias("stem"), "titles", F.lit(False).alias("exists"))
    joined = out.join(existing.select("key", F.col("stem").alias("found")), "key", "left")
    return joined.select("kind", "name", F.coalesce("found", slug("name")).alias("stem"), "titles", F.col("found").isNotNull().alias("exists"))


def _turn(kind: Column | str) -> Column:
    """The order in which kinds of hubs are written."""
    return F.when(c(kind) == "Kategorie", 0).when(c(kind) == "Tag", 1).otherwise(2)


def _link_list(titles: Column) -> Column:
    return F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- [["), slug(t), F.lit("]]"))), "\n")


def hub_text(kind: Column | str, name: Column | str, titles: Column | str) -> Column:
    n = F.size(c(titles)).cast("string")
    return F.concat(F.lit("---\nsource: import\n---\n\n# "), c(name), F.lit("\n\n"), c(kind), F.lit(" mit "), n, F.lit(" Beiträgen:\n\n"), _link_list(c(titles)), F.lit("\n"))


def block_text(name: Column | str, titles: Column | str) -> Column:
    n = F.size(c(titles)).cast("string")
    return F.concat(F.lit(f"{BLOCK_START}\n\n## "), c(name), F.lit(" · "), n, F.lit(" Beiträge\n\n"), _link_list(c(titles)), F.lit(f"\n\n{BLOCK_END}"))


def notes_of(posts: DataFrame, folder: str, existing: DataFrame | None = None) -> DataFrame:
    """path, content, kind of all notes that an import makes: posts, and hubs that are not there yet.

    Hubs are written after the posts, by kind and name; of several notes for one
    path the last stands. A hub's row holds the titles of all its posts, as its
    note does.
    """
    prefix = folder.strip().strip("/")
    prefix = prefix + "/" if prefix else ""
    hub = hubs(posts, existing)
    goal = hub.groupBy("name").agg(F.min("stem").alias("stem"))
    linked = terms(posts).join(goal, "name").groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("kind", "nth", "stem"))).alias("links"))
    rows = posts.join(unique_stems(posts), "pos").join(linked, "pos", "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<kind:string,nth:int,stem:string>>")))
    of = lambda kind: F.transform(F.filter("links", lambda x: x["kind"] == kind), lambda x: F.concat(F.lit("[["), x["stem"], F.lit("]]")))
    line = lambda label, kind: F.when(F.size(of(kind)) > 0, F.concat(F.lit(f"\n\n**{label}:** "), F.array_join(of(kind), " "))).otherwise("")
    head = F.concat(F.lit("---\nsource: import\n"), F.when(F.col("link") != "", F.concat(F.lit("url: "), "link", F.lit("\n"))).otherwise(""), F.when(F.col("date") != "", F.concat(F.lit("date: "), "date", F.lit("\n"))).otherwise(""), F.lit("---\n\n# "), "title", F.lit("\n"))
    byline = F.when(F.col("author") != "", F.concat(F.lit("\n*von "), F.get(of("Autor"), F.lit(0)), F.lit("*\n"))).otherwise("")
    text = F.concat(head, byline, F.lit("\n"), to_markdown("content_html"), line("Kategorien", "Kategorie"), line("Tags", "Tag"), F.lit("\n"))
    first = F.get("categories", F.lit(0))
    sub = F.when(F.coalesce(first, F.lit("")) != "", F.concat(slug(first), F.lit("/"))).otherwise("")
    made = rows.select(F.concat(F.lit(prefix), sub, "stem", F.lit(".md")).alias("path"), text.alias("content"), F.lit("post").alias("kind"))
    fresh = hub.where("not exists").select(F.concat(F.lit(prefix), "stem", F.lit(".md")).alias("path"), "kind", "name", "titles")
    fresh = fresh.groupBy("path").agg(F.max_by(F.struct("kind", "name", "titles"), F.struct(_turn("kind"), "name")).alias("h"))
    fresh = fresh.select("path", hub_text("h.kind", "h.name", "h.titles").alias("content"), F.lit("hub").alias("kind"))
    return made.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)


def summary(posts: DataFrame, notes: DataFrame) -> DataFrame:
    """One row of counts: posts, hubs, authors."""
    authors = posts.where("author <> ''").select("author").distinct()
    return notes.agg(F.count_if(F.col("kind") == "post").alias("posts"), F.count_if(F.col("kind") == "hub").alias("hubs")).withColumn("authors", authors.select(F.count(F.lit(1))).scalar())
