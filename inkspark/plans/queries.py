"""Registered queries over derived notes, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import names as nm
from ..lineage import scratch
from ..operators import folders, graph, history, importing, journal, rewrite, search
from ..operators.gramindex import GramIndex
from ..operators.pageindex import PageIndex
from ..operators.termindex import TermIndex
from ..sources import derived
from ..sources.derived import NOTES_CTE, POSTS_CTE, SNAPSHOTS_CTE
from ..streaming.livegraph import LiveGraph
from . import dql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def FOLDED(source: str) -> str:
    """DuckDB: pos, stem of ``source`` (pos, stem), each name counted on from 2 until it is free of those before."""
    return f"""fam AS (SELECT list(pos ORDER BY pos) AS ps, list(stem ORDER BY pos) AS ss FROM {source} GROUP BY lower(regexp_replace(stem, '( [0-9]+)+$', ''))),
folded AS (SELECT ps, list_reduce(list_prepend([]::VARCHAR[], list_transform(ss, lambda s: [s])), lambda a, x: list_append(a,
  list_filter(list_prepend(x[1], list_transform(range(2, len(a) + 3), lambda n: x[1] || ' ' || n)), lambda y: NOT list_contains(list_transform(a, lambda z: lower(z)), lower(y)))[1])) AS names FROM fam),
stems AS (SELECT unnest(ps) AS pos, unnest(names) AS stem FROM folded)"""


STEM = "regexp_replace({0}, '^(?:.*/)?([^/]*?)(?:\\.md)?$', '\\1')"
LINKS_CTE = r"""
raw AS (
  SELECT path AS src, modified, unnest(regexp_extract_all(content, '(?s)\[\[(.*?)\]\]', 1)) AS inner_text,
         generate_subscripts(regexp_extract_all(content, '(?s)\[\[(.*?)\]\]', 1), 1) - 1 AS pos
  FROM notes),
links AS (
  SELECT src, pos, trim(regexp_extract(inner_text, '(?s)^([^|#^]*)', 1)) AS target,
         lower(trim(regexp_extract(inner_text, '(?s)^([^|#^]*)', 1))) AS name
  FROM raw),
names AS (SELECT lower('Doc ' || doc_id) AS name, path AS dst FROM notes),
resolved AS (SELECT l.*, n.dst FROM links l LEFT JOIN names n USING (name) WHERE l.name <> ''),
edges AS (SELECT src AS source, coalesce(dst, 'missing:' || name) AS target FROM resolved WHERE dst IS NULL OR dst <> src)
"""


def with_notes(sql: str) -> str:
    return f"WITH {NOTES_CTE} {sql}"


def with_links(sql: str) -> str:
    return f"WITH {NOTES_CTE}, {LINKS_CTE} {sql}"


# --- the query language ----------------------------------------------------


def _answer(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    result = dql.run(derived.notes(spark, sf_dir), text)
    if result.kind == "table":
        return result.frame.select("path", F.array_join("row", "|").alias("cells"))
    return result.frame


FIELD = "CASE WHEN {0} IS NULL THEN '' ELSE CAST({0} AS VARCHAR) END"
B = f"""{NOTES_CTE}, b AS (
  SELECT base.*, notes.path, notes.content, notes.modified FROM base JOIN notes USING (doc_id))"""


@query(f"""WITH {B} SELECT path, n_chars || '|' || {FIELD.format('quality')} AS cells FROM b
WHERE n_chars >= 3000 ORDER BY n_chars DESC, path LIMIT 50""")
def dql_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, 'TABLE n_chars AS "chars", quality\nFROM #doc\nWHERE n_chars >= 3000\nSORT n_chars DESC\nLIMIT 50')


@query(f"""WITH {B} SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'ai' ELSE '[[Doc ' || doc_id || ']]' END AS item FROM b
WHERE lang = 'en' AND quality = 1""")
def dql_list_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, 'LIST author FROM "en" WHERE quality = 1')


@query(f"""WITH {B} SELECT path, 'Doc ' || doc_id || '|' || source AS cells FROM b
WHERE doc_id % 6 = 0 AND coalesce(toxic, 0) <> 1""")
def dql_nested_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "TABLE file.name, source FROM #topic WHERE toxic != 1 SORT source")


@query(f"WITH {B} SELECT path, source || '|' || 'Doc ' || doc_id AS cells FROM b WHERE source > 'src15'")
def dql_text_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, 'TABLE source, title WHERE source > "SRC15" SORT title DESC')


@query(f"""WITH {B} SELECT path, '[[Doc ' || doc_id || ']]' AS item FROM b
WHERE quality IS NULL ORDER BY path LIMIT 100""")
def dql_missing_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, 'LIST WHERE quality = "" SORT file.path LIMIT 100')


@query(f"""WITH {B},
t AS (
  SELECT path, unnest(list_concat(['doc', 'lang/' || lang], regexp_extract_all(regexp_replace(content, '(?s)^---.*?\\n---\\n?', ''), '(?:^|\\s)#([A-Za-z0-9_/-]+)', 1))) AS tag FROM b),
g AS (SELECT path, string_agg(DISTINCT lower(tag), '|' ORDER BY lower(tag)) AS tags FROM t GROUP BY path)
SELECT b.path, 'Doc ' || doc_id AS title, g.tags,
  array_to_string(list_sort(list_filter([
    CASE WHEN doc_id % 4 = 0 THEN 'ai_client=' || CASE WHEN doc_id % 8 = 0 THEN 'scribe' ELSE 'drafter' END END,
    CASE WHEN doc_id % 4 = 0 THEN 'author=ai' END,
    'file.link=[[Doc ' || doc_id || ']]', 'file.name=Doc ' || doc_id, 'file.path=' || b.path, 'n_chars=' || n_chars,
    'quality=' || quality, 'source=' || source, 'tags=doc, lang/' || lang, 'title=Doc ' || doc_id, 'toxic=' || toxic], lambda x: x IS NOT NULL)), '|') AS fields
FROM b JOIN g ON g.path = b.path""")
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return dql.pages(derived.notes(spark, sf_dir)).select("path", "title", F.array_join("tags", "|").alias("tags"), F.array_join(entries, "|").alias("fields"))


@query(f"""WITH {B}, k AS (SELECT * FROM b WHERE doc_id % 10 <> 7)
SELECT 'late' AS asked, path, 'Doc ' || doc_id AS cells FROM k WHERE doc_id % 10 = 5
UNION ALL SELECT 'long', path, n_chars || '|' || CASE WHEN doc_id % 10 = 5 AND quality = 1 THEN '' ELSE {FIELD.format('quality')} END FROM k WHERE n_chars >= 3000
UNION ALL SELECT 'topic', path, source FROM k WHERE lang = 'en' AND doc_id % 6 = 0 AND doc_id % 3 = 0 AND doc_id % 10 <> 5
UNION ALL SELECT 'good', path, source FROM k WHERE quality = 1 AND doc_id % 10 <> 5""")
def dql_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to a stored page index after notes were changed and deleted in it."""
    notes = derived.notes(spark, sf_dir).select("path", "content")
    ends = lambda d: F.col("path").endswith(f"{d}.md")
    late = notes.where(ends(5)).select("path", F.concat(F.regexp_replace("content", "(?m)^quality: 1\n|tagged #", ""), F.lit("\n#late\n")).alias("content"))
    index = PageIndex.build(notes, scratch(spark, "pages")).refresh(late, notes.where(ends(7)).select("path"))
    asked = {"late": "TABLE title FROM #late", "long": "TABLE n_chars, quality WHERE n_chars >= 3000", "topic": "TABLE source FROM #topic/0", "good": "TABLE source WHERE quality = 1"}
    parts = [index.run(text).frame.select(F.lit(name).alias("asked"), "path", F.array_join("row", "|").alias("cells")) for name, text in asked.items()]
    parts[2] = parts[2].where(F.col("path").startswith("en/"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- scans and metadata ----------------------------------------------------


@query(f"""WITH {B} SELECT path, 'Doc ' || doc_id AS title, doc_id % 4 = 0 AS ai_authored,
CASE WHEN doc_id % 8 = 0 THEN 'scribe' WHEN doc_id % 4 = 0 THEN 'drafter' END AS ai_client, modified FROM b""")
def note_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.meta(derived.notes(spark, sf_dir)).orderBy(F.lower("title"), "path")


@query(with_notes("SELECT path, content FROM notes WHERE doc_id = 17"))
def read_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = derived.notes(spark, sf_dir)
    return notes.where(nm.stem("path") == "Doc 17").select("path", "content")


@query("""SELECT 'Chat/conv ' || conv_id || '.md' AS path, 'conv' AS kind, bool_or(role = 'assistant') AS ai,
count(*) AS turns FROM conversations GROUP BY conv_id""")
def chat_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = derived.chat_notes(spark, sf_dir)
    turns = derived.table(spark, sf_dir, "conversations").groupBy(F.format_string("Chat/conv %d.md", "conv_id").alias("path")).agg(F.count(F.lit(1)).alias("turns"))
    return notes.select("path", F.lit("conv").alias("kind"), md.is_ai("content").alias("ai")).join(turns, "path")


@query(f"""WITH {B} SELECT path, regexp_replace(content, '\\s+$', '') || chr(10) || chr(10) || 'more' || chr(10) AS content FROM b""")
def append_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends to notes whose last line end gives way to a blank line."""
    return derived.notes(spark, sf_dir).select("path", nm.appended("content", F.lit("  more ")).alias("content"))


@query(f"""WITH {B} SELECT path, false AS created FROM b
UNION ALL SELECT 'new/Note ' || doc_id || '.md', true FROM b""")
def open_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = derived.notes(spark, sf_dir)
    n = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long")
    wanted = notes.select("path").unionByName(notes.select(F.concat(F.lit("new/Note "), n.cast("string"), F.lit(".md")).alias("path")))
    return rewrite.open_or_create(notes, wanted)


# --- the link graph --------------------------------------------------------


@query(with_links("SELECT src, pos, target FROM links WHERE target <> ''"))
def link_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.link_rows(derived.notes(spark, sf_dir)).select("src", F.col("pos").cast("long").alias("pos"), "target")


@query(with_links("SELECT source, target FROM edges"))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(derived.notes(spark, sf_dir))


DEGREE = "degree AS (SELECT path, count(*) AS degree FROM (SELECT source AS path FROM edges UNION ALL SELECT target FROM edges) GROUP BY path)"


@query(with_links(f""", {DEGREE},
all_nodes AS (
  SELECT path, 'Doc ' || doc_id AS title, doc_id % 4 = 0 AS ai_authored, CASE WHEN doc_id % 8 = 0 THEN 'scribe' WHEN doc_id % 4 = 0 THEN 'drafter' END AS ai_client, false AS missing FROM notes
  UNION ALL SELECT DISTINCT 'missing:' || name, target, false, NULL, true FROM resolved WHERE dst IS NULL)
SELECT n.*, coalesce(d.degree, 0) AS degree FROM all_nodes n LEFT JOIN degree d USING (path)"""))
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(derived.notes(spark, sf_dir))


@query(f"""WITH {NOTES_CTE}, seen AS (SELECT * FROM notes WHERE NOT starts_with(path, 'fr/')),
{LINKS_CTE.replace('FROM notes', 'FROM seen')} SELECT source, target, count(*) AS n FROM edges GROUP BY ALL""")
def graph_excluding_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(derived.notes(spark, sf_dir), ["/fr/"]).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query(with_links("SELECT DISTINCT dst, src FROM resolved WHERE dst <> src"))
def backlinks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.backlinks(derived.notes(spark, sf_dir))


def _path_of(spark: SparkSession, sf_dir: str, doc_id: int) -> str:
    row = derived.table(spark, sf_dir, "documents").where(F.col("doc_id") == doc_id).select("lang", "source").first()
    return f"{row.lang}/{row.source}/Doc {doc_id}.md"


@query(with_links("SELECT DISTINCT src AS path, 'Doc ' || regexp_extract(src, '([0-9]+)\\.md$', 1) AS title FROM resolved WHERE name = 'doc 10' AND src <> dst"))
def backlinks_of_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.deletion_report(derived.notes(spark, sf_dir), _path_of(spark, sf_dir, 10))


@query(with_links("""SELECT src, min(pos) AS pos, arg_min(target, pos) AS target, any_value(dst) AS dst
FROM resolved GROUP BY src, name"""))
def outgoing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.outgoing(derived.notes(spark, sf_dir)).select("src", F.col("pos").cast("long").alias("pos"), "target", "dst")


@query(with_links("SELECT target, count(*) AS n FROM resolved WHERE dst IS NULL GROUP BY target"))
def dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dead_links(derived.notes(spark, sf_dir))


@query(with_links(f""", {DEGREE},
inl AS (SELECT target AS path, count(DISTINCT source) AS in_links FROM edges GROUP BY target),
p AS (SELECT path FROM notes UNION SELECT target FROM edges),
v AS (SELECT p.path, coalesce(degree, 0) AS degree, coalesce(in_links, 0) AS in_links FROM p LEFT JOIN degree USING (path) LEFT JOIN inl USING (path)),
r AS (SELECT *, row_number() OVER (ORDER BY in_links DESC, degree DESC, path) AS k FROM v)
SELECT path, degree, in_links, CASE WHEN in_links >= 20 THEN 8.5 WHEN in_links >= 8 THEN 6.75 WHEN in_links >= 3 THEN 5.25 WHEN in_links >= 1 THEN 4.0 ELSE 3.0 END::DOUBLE AS radius,
CASE WHEN k <= 14 THEN k END AS hub FROM r"""))
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.view(derived.notes(spark, sf_dir)).withColumn("hub", F.col("hub").cast("long"))


@query(with_links("SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges"))
def graph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pairs(derived.notes(spark, sf_dir))


@query("""WITH e AS (
  SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node),
n AS (SELECT DISTINCT a AS node FROM e)
SELECT n.node || '.md' AS path, n.node AS title, false AS missing, degree FROM n JOIN d USING (node)
UNION ALL SELECT 'missing:' || node, node, true, degree FROM d WHERE node NOT IN (SELECT node FROM n)""")
def degree_at_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's nodes where customers link to nations and orders to customers; nations have no note."""
    customer, orders = derived.table(spark, sf_dir, "customer"), derived.table(spark, sf_dir, "orders")
    one = customer.select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    two = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"))
    linked = one.unionByName(two).select(F.concat("a", F.lit(".md")).alias("path"), F.concat(F.lit("[["), "b", F.lit("]]")).alias("line"))
    notes = linked.select("path", F.concat(F.lit("# "), F.regexp_replace("path", r"\.md$", ""), F.lit("\n"), "line").alias("content"), F.lit(0).cast("long").alias("modified"))
    return graph.nodes(notes).select("path", "title", "missing", "degree")


#: Notes after some were deleted and some written anew.
LATER_CTE = NOTES_CTE.replace("notes AS (SELECT", "before AS (SELECT") + """,
notes AS (SELECT path, doc_id, modified, CASE WHEN doc_id % 10 = 5 THEN '# Late ' || doc_id || chr(10) || '[[Doc ' || doc_id // 10 || ']] [[missing 3]]' ELSE content END AS content FROM before WHERE doc_id % 10 <> 7)"""


@query(f"""WITH {LATER_CTE}, {LINKS_CTE}, {DEGREE},
titled AS (SELECT path, CASE WHEN doc_id % 10 = 5 THEN 'Late ' || doc_id ELSE 'Doc ' || doc_id END AS title, doc_id % 4 = 0 AND doc_id % 10 <> 5 AS ai_authored,
  CASE WHEN doc_id % 10 = 5 THEN NULL WHEN doc_id % 8 = 0 THEN 'scribe' WHEN doc_id % 4 = 0 THEN 'drafter' END AS ai_client, false AS missing FROM notes),
ghosts AS (SELECT 'missing:' || name AS path, first(target ORDER BY lower(t.title), src, pos) AS title, false, NULL, true FROM resolved JOIN titled t ON t.path = src WHERE dst IS NULL GROUP BY name),
all_nodes AS (SELECT * FROM titled UNION ALL SELECT * FROM ghosts)
SELECT n.*, coalesce(d.degree, 0) AS degree FROM all_nodes n LEFT JOIN degree d USING (path)""")
def live_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a kept graph that took all notes, and then a batch in which some go and some change their links."""
    notes = derived.notes(spark, sf_dir)
    number = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long")
    text = F.concat(F.lit("# Late "), number.cast("string"), F.lit("\n[[Doc "), F.floor(number / 10).cast("string"), F.lit("]] [[missing 3]]"))
    later = notes.where((number % 10).isin(5, 7)).select("path", F.when(number % 10 == 5, text).alias("content"), (F.col("modified") + 1).alias("modified"))
    return LiveGraph(spark, scratch(spark, "graph")).apply(notes).apply(later).nodes()


# --- search and similarity -------------------------------------------------

SNIPPET = "'…' || trim(replace(substr({c}, greatest(hit_at - 30, 1), {n} + 70), chr(10), ' '), ' ' || chr(9) || chr(10) || chr(13)) || '…'"


@query(with_notes(f""", h AS (SELECT path, 'Doc ' || doc_id AS title, content, strpos(lower(content), 'license') AS hit_at FROM notes)
SELECT path, title, {SNIPPET.format(c='content', n=7)} AS snippet FROM h WHERE hit_at > 0"""))
def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(derived.notes(spark, sf_dir), "LICENSE")


@query(with_notes(f""", h AS (SELECT path, 'Doc ' || doc_id AS title, content, regexp_extract(content, '[A-Z]{{4,}}!!') AS hit FROM notes),
k AS (SELECT *, strpos(content, hit) AS hit_at FROM h WHERE hit <> '')
SELECT path, title, {SNIPPET.format(c='content', n='length(hit)')} AS snippet FROM k"""))
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(derived.notes(spark, sf_dir), "/[A-Z]{4,}!!/")


@query(with_notes(f""", h AS (SELECT path, 'Doc ' || doc_id AS title, content, strpos(lower(content), 'missing 7') AS at1, strpos(lower(content), 'see doc 1') AS at2 FROM notes),
k AS (SELECT path, title, content, 'Missing 7' AS sought, at1 AS hit_at, 9 AS n FROM h WHERE at1 > 0 UNION ALL SELECT path, title, content, 'see doc 1', at2, 9 FROM h WHERE at2 > 0
  UNION ALL SELECT path, title, content, 'pattern', strpos(content, hit), length(hit) FROM (SELECT *, regexp_extract(content, '[a-z]+ Doc 2[0-9]* today') AS hit FROM h) WHERE hit <> '')
SELECT sought, path, title, {SNIPPET.format(c='content', n='n')} AS snippet FROM k"""))
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two literals and a pattern through a stored gram index, which is built here and read as any later search reads it."""
    index = GramIndex.build(derived.notes(spark, sf_dir).select("path", "content"), scratch(spark, "grams"))
    asked = {"Missing 7": "Missing 7", "see doc 1": "see doc 1", "pattern": r"re:[a-z]+ Doc 2\d* today"}
    found = [index.search(text).select(F.lit(name).alias("sought"), "path", "title", "snippet") for name, text in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""WITH {B}, s AS (SELECT path, doc_id, regexp_replace(content, '(?s)\\[\\[.*?\\]\\]', ' ', 'g') AS text, content FROM b),
m AS (SELECT path, doc_id, len(regexp_extract_all(lower(text), '(?:^|[^\\pL\\pN_])doc 1(?:$|[^\\pL\\pN_])')) AS n, content FROM s)
SELECT path, 'Doc ' || doc_id AS title, CAST(n AS BIGINT) AS "count" FROM m
WHERE n > 0 AND doc_id <> 1 AND NOT regexp_matches(lower(content), '\\[\\[doc 1(?:[|#^][^\\]]*)?\\]\\]')""")
def unlinked_mentions_of_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.unlinked_mentions(derived.notes(spark, sf_dir), _path_of(spark, sf_dir, 1), "Doc 1").select("path", "title", "count")


@query(with_links(""",
m AS (SELECT path, unnest(regexp_extract_all(lower(regexp_replace(content, '(?s)\\[\\[.*?\\]\\]', ' ', 'g')), '(?:^|[^\\pL\\pN_])(doc [0-9]+)(?:$|[^\\pL\\pN_])', 1)) AS name FROM notes)
SELECT m.path, n.dst, count(*) AS "count" FROM m JOIN names n USING (name)
WHERE m.path <> n.dst AND NOT EXISTS (SELECT 1 FROM links l WHERE l.src = m.path AND l.name = m.name) GROUP BY ALL"""))
def unlinked_mentions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.all_mentions(derived.notes(spark, sf_dir))


COMMON = ", ".join(f"'{w}'" for w in md.COMMON_WORDS)
MINOR = ", ".join(f"'{w}'" for w in md.MINOR_WORDS)


@query(with_links(f""",
t AS (SELECT path, unnest(list_transform(regexp_extract_all(content, '[\\pL\\pN_]+'), lambda x: lower(x))) AS term FROM notes),
c AS (SELECT path, term, count(*) AS n FROM t WHERE length(term) >= 3 AND term NOT IN ({COMMON}) GROUP BY ALL),
w AS (SELECT path, term, n / sum(n) OVER (PARTITION BY path) * (ln((SELECT count(*) FROM notes) / count(*) OVER (PARTITION BY term)) + 1) AS weight FROM c),
norm AS (SELECT path, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY path),
me AS (SELECT path AS p FROM notes WHERE doc_id = 11),
dot AS (SELECT w.path, sum(w.weight * o.weight) AS dot FROM w JOIN w o USING (term) WHERE o.path = (SELECT p FROM me) AND w.path <> o.path GROUP BY w.path),
near AS (SELECT DISTINCT CASE WHEN src = (SELECT p FROM me) THEN dst ELSE src END AS path FROM resolved WHERE dst IS NOT NULL AND (src = (SELECT p FROM me) OR dst = (SELECT p FROM me)))
SELECT dot.path, round(dot / (norm * (SELECT norm FROM norm WHERE path = (SELECT p FROM me))), 6) AS score, near.path IS NOT NULL AS linked
FROM dot JOIN norm USING (path) LEFT JOIN near USING (path) ORDER BY score DESC, dot.path LIMIT 8"""))
def related_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.related(derived.notes(spark, sf_dir), _path_of(spark, sf_dir, 11), 8)


@query(ORACLES["related_notes"])
def related_notes_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stored index, which is built here and read as any later query reads it."""
    index = TermIndex.build(derived.notes(spark, sf_dir).select("path", "content"), scratch(spark, "terms"))
    return index.related(_path_of(spark, sf_dir, 11), 8)


@query(with_notes(f""",
q AS (SELECT item_id AS id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[\\pL\\pN]+'), lambda x: lower(x)), lambda x: strlen(x) >= 3 AND x NOT IN ({MINOR}))) AS terms FROM benchmark),
d AS (SELECT path, list_distinct(list_filter(list_transform(regexp_extract_all('Doc ' || doc_id || ' ' || content, '[\\pL\\pN]+'), lambda x: lower(x)), lambda x: strlen(x) >= 3 AND x NOT IN ({MINOR}))) AS terms FROM notes),
qt AS (SELECT id, len(terms) AS size, unnest(terms) AS term FROM q),
dt AS (SELECT path, unnest(terms) AS term FROM d),
s AS (SELECT id, path, round(count(*) / any_value(size), 6) AS score FROM qt JOIN dt USING (term) GROUP BY id, path),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, path) AS rank FROM s)
SELECT id, path, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8"""))
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = derived.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return search.link_candidates(derived.notes(spark, sf_dir), texts, 8)


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT DISTINCT substr(p_name, 1, length(p_name) - 2) AS target FROM part),
tb AS (SELECT target, g, row_number() OVER (PARTITION BY target, g) AS k, count(*) OVER (PARTITION BY target) AS size FROM (SELECT target, unnest(list_transform(range(1, length(target)), lambda i: substr(lower(target), i, 2))) AS g FROM t)),
nb AS (SELECT name, g, row_number() OVER (PARTITION BY name, g) AS k, count(*) OVER (PARTITION BY name) AS size FROM (SELECT name, unnest(list_transform(range(1, length(name)), lambda i: substr(lower(name), i, 2))) AS g FROM n)),
s AS (SELECT target, name, round(CASE WHEN lower(target) = lower(name) THEN 1.0 ELSE 2.0 * count(*) / (any_value(tb.size) + any_value(nb.size)) END, 6) AS score FROM tb JOIN nb USING (g, k) GROUP BY target, name),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, name) AS rank FROM s WHERE score > 0.3)
SELECT target, name, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derived.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    cut = parts.select(F.expr("substr(name, 1, length(name) - 2)").alias("target"))
    return search.suggestions(cut, parts)


# --- rewriting -------------------------------------------------------------


@query(with_notes("""SELECT path, 'Doc ' || doc_id AS title, CAST((length(content) - length(replace(content, 'the', ''))) / 3 AS BIGINT) AS "count" FROM notes
WHERE contains(content, 'the')"""))
def replace_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.replace_preview(derived.notes(spark, sf_dir), "the")


@query(with_notes("""SELECT path, 'Doc ' || doc_id AS old, replace('Doc ' || doc_id, '99', 'ninety-nine') AS new FROM notes
WHERE contains('Doc ' || doc_id, '99')"""))
def rename_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.rename_preview(derived.notes(spark, sf_dir), "99", "ninety-nine")


@query(with_notes("""SELECT CASE WHEN doc_id = 3 THEN regexp_replace(path, 'Doc 3\\.md$', 'Third-Doc.md') ELSE path END AS path,
regexp_replace(content, '(?i)\\[\\[\\s*Doc 3\\s*([|#^][^\\]]*)?\\]\\]', '[[Third-Doc\\1]]', 'g') AS content,
regexp_replace(content, '(?i)\\[\\[\\s*Doc 3\\s*([|#^][^\\]]*)?\\]\\]', '[[Third-Doc\\1]]', 'g') <> content AS changed FROM notes"""))
def rename_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.rename(derived.notes(spark, sf_dir), _path_of(spark, sf_dir, 3), "Third/Doc")


@query(with_notes("SELECT path, replace(content, 'the', 'THE') AS content FROM notes"))
def replace_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.replace_text(derived.notes(spark, sf_dir), "the", "THE").select("path", "content")


@query(with_links(""",
r AS (SELECT path AS was, regexp_replace(path, '/[^/]*$', '') AS dir, 'doc ' || doc_id AS name, trim(replace('Doc ' || doc_id, '0', '')) AS new FROM notes WHERE contains('Doc ' || doc_id, '0')),
s AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, 'Doc ' || doc_id AS new FROM notes WHERE NOT contains('Doc ' || doc_id, '0')),
k AS (SELECT r.*, row_number() OVER (PARTITION BY r.dir, r.new ORDER BY was) + CASE WHEN s.new IS NULL THEN 0 ELSE 1 END AS n FROM r LEFT JOIN s ON s.dir = r.dir AND s.new = r.new),
t AS (SELECT was, dir, name, CASE WHEN n = 1 THEN new ELSE new || ' ' || n END AS stem FROM k),
l AS (SELECT links.src, string_agg(trim(replace(coalesce(t.stem, links.target), '0', '')), '|' ORDER BY pos) AS links FROM links LEFT JOIN t ON t.name = links.name GROUP BY links.src)
SELECT notes.path AS was, CASE WHEN t.stem IS NULL THEN notes.path ELSE t.dir || '/' || t.stem || '.md' END AS path, l.links FROM notes LEFT JOIN t ON t.was = notes.path LEFT JOIN l ON l.src = notes.path"""))
def replace_with_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All noughts go, from names too, so that many names meet; links follow."""
    done = rewrite.replace_all(derived.notes(spark, sf_dir).select("path", "content"), "0", "", True)
    return done.select("was", "path", F.array_join(md.links("content"), "|").alias("links"))


@query(with_notes("""SELECT CASE WHEN starts_with(path, 'de/src5/') THEN 'archive/src5/' || substr(path, 9) ELSE path END AS path, modified FROM notes"""))
def move_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.move_folder(derived.notes(spark, sf_dir), "de/src5", "archive").select("path", "modified")


@query(with_notes("SELECT path FROM notes WHERE NOT starts_with(path, 'es/')"))
def delete_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.delete_folder(derived.notes(spark, sf_dir), "es").select("path")


@query(f"""WITH t AS (SELECT p_partkey AS pos, regexp_replace(p_name, '[/\\\\:*?"<>|]', '-', 'g') AS stem FROM part), {FOLDED('t')} SELECT pos, stem FROM stems""")
def unique_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.unique_stems(derived.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("title")))


@query(f"""WITH t AS (SELECT p_partkey AS pos, upper(substr(p_name, 1, p_partkey % 2)) || substr(split_part(p_name, ' ', 1), 1 + p_partkey % 2) || CASE WHEN p_partkey % 3 = 0 THEN ' ' || (1 + p_size % 4) ELSE '' END AS stem FROM part), {FOLDED('t')} SELECT pos, stem FROM stems""")
def numbered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that meet each other's numbered forms, in any case."""
    title = "upper(substr(p_name, 1, p_partkey % 2)) || substr(split_part(p_name, ' ', 1), 1 + p_partkey % 2) || CASE WHEN p_partkey % 3 = 0 THEN ' ' || (1 + p_size % 4) ELSE '' END"
    return rewrite.unique_stems(derived.table(spark, sf_dir, "part").selectExpr("p_partkey AS pos", f"{title} AS title"))


@query(with_notes("""SELECT CASE WHEN doc_id = 3 THEN regexp_replace(path, '[^/]*$', '') || 'Doc ' || (SELECT min(n.doc_id) FROM notes n JOIN notes m ON m.doc_id = 3 WHERE n.doc_id <> 3 AND regexp_replace(n.path, '[^/]*$', '') = regexp_replace(m.path, '[^/]*$', '')) || ' 2.md' ELSE path END AS path FROM notes"""))
def rename_onto_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note renamed to a name that another has in its folder."""
    rows, path = derived.notes(spark, sf_dir), _path_of(spark, sf_dir, 3)
    number = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long")
    taken = rows.where(F.col("path").startswith(path.rpartition("/")[0] + "/") & (F.col("path") != path)).agg(F.min(number)).scalar()
    name = spark.range(1).select(taken.alias("n")).first()["n"]
    return rewrite.rename(rows, path, f"Doc {name}").select("path")


# --- history ---------------------------------------------------------------


@query(f"""WITH {SNAPSHOTS_CTE},
i AS (SELECT *, max(taken_at - n) OVER (PARTITION BY path ORDER BY taken_at, tie) + n AS id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY taken_at, tie) AS n FROM snaps)),
d AS (SELECT *, lag(content) OVER (PARTITION BY path ORDER BY taken_at, tie) AS before FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY taken_at DESC, tie DESC) AS rn FROM d WHERE before IS NULL OR before <> content)
SELECT path, id, taken_at, strlen(content) AS bytes, content FROM k WHERE rn <= 50""")
def version_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.versions(derived.snapshots(spark, sf_dir))


@query(f"""WITH {SNAPSHOTS_CTE.replace('epoch_us(ts) // 1000', 'epoch_us(ts) // 1000000 // 600 * 600000')},
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY taken_at, tie) AS n FROM snaps)
SELECT path, tie, max(taken_at - n) OVER (PARTITION BY path ORDER BY taken_at, tie) + n AS id FROM n""")
def version_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids on a log whose times are coarsened to ten minutes, so that many collide."""
    log = derived.snapshots(spark, sf_dir).withColumn("taken_at", F.floor(F.col("taken_at") / 600_000) * 600_000)
    return history.distinct_ids(log).select("path", "tie", "id")


@query(f"""WITH RECURSIVE {SNAPSHOTS_CTE},
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY taken_at, tie) AS n FROM snaps),
keep AS (
  SELECT path, taken_at, tie, n FROM o WHERE n = 1
  UNION ALL
  SELECT o.path, o.taken_at, o.tie, o.n FROM keep k, LATERAL (
    SELECT * FROM o WHERE o.path = k.path AND o.n > k.n AND o.taken_at - k.taken_at >= 36000000 ORDER BY o.n LIMIT 1) o)
SELECT path, taken_at, tie FROM keep""")
def throttled_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.throttled(derived.snapshots(spark, sf_dir), 36_000)


@query("""WITH l AS (
  SELECT conv_id AS id, turn, coalesce(replace(text, chr(10), ' '), '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
x AS (SELECT *, lead(text) OVER (PARTITION BY id ORDER BY pos) AS after FROM l),
gone AS (SELECT id, min(pos) AS at FROM x WHERE after IS NULL OR text <> after GROUP BY id)
SELECT x.id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos = gone.at THEN 'del' ELSE 'same' END AS kind, text FROM x JOIN gone USING (id) WHERE n > 1
UNION ALL SELECT id, 0, CASE WHEN text = '' THEN 'same' ELSE 'del' END, text FROM l WHERE n = 1
UNION ALL SELECT id, 1, 'add', '' FROM l WHERE n = 1 AND text <> ''""")
def line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs of each conversation's turns, one to a line, against those without the first."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    turns = derived.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.alias("text")))).alias("rows"))
    lines = F.col("rows.text")
    pairs = turns.select(F.col("conv_id").alias("id"), F.array_join(lines, "\n").alias("before"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n").alias("after"))
    return history.diffs(pairs)


# --- folders, calendars, feeds ---------------------------------------------


@query(with_notes(""", f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir FROM notes),
t AS (SELECT path, count(*) AS total FROM (SELECT dir AS path FROM f UNION ALL SELECT split_part(dir, '/', 1) FROM f) GROUP BY path),
o AS (SELECT dir AS path, count(*) AS own FROM f GROUP BY dir)
SELECT t.path, CASE WHEN contains(t.path, '/') THEN split_part(t.path, '/', 1) ELSE '' END AS parent, regexp_extract(t.path, '([^/]*)$', 1) AS name,
CASE WHEN contains(t.path, '/') THEN 2 ELSE 1 END::BIGINT AS depth, coalesce(own, 0) AS own, total FROM t LEFT JOIN o USING (path)"""))
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.tree(derived.notes(spark, sf_dir))


@query(with_notes("SELECT DISTINCT unnest([split_part(path, '/', 1), regexp_replace(path, '/[^/]*$', '')]) AS folder FROM notes"))
def folder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.folder_list(derived.notes(spark, sf_dir))


@query(with_notes("SELECT path FROM notes WHERE starts_with(path, 'de/src3/')"))
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.listing(derived.notes(spark, sf_dir), "DE/Src3", recursive=False).select("path")


@query(f"""WITH {B} SELECT path, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 8 = 0 THEN 'scribe' ELSE 'drafter' END AS client, modified FROM b WHERE doc_id % 4 = 0""")
def ai_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.ai_review(derived.notes(spark, sf_dir))


@query("""SELECT 'Journal/' || strftime(ts, '%Y-%m-%d') || '.md' AS path,
string_agg('- ' || strftime(ts, '%H:%M') || ' ' || event_type, chr(10) ORDER BY ts, event_id) AS content FROM events GROUP BY 1""")
def daily_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.day_notes(spark, sf_dir).select("path", "content")


@query("""SELECT CAST(n AS INTEGER) AS cell, strftime(d, '%Y-%m-%d') AS day, d IN (SELECT CAST(ts AS DATE) FROM events) AS has_note
FROM (SELECT unnest(range(1, 32)) AS n, unnest(list_transform(range(0, 31), lambda i: DATE '2024-01-01' + CAST(i AS INTEGER))) AS d)""")
def month_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.month_grid(spark, derived.day_notes(spark, sf_dir), "Journal", 2024, 1)


@query("""WITH l AS (SELECT p_partkey AS pos, p_name AS label, lower(p_name) AS t FROM part),
p AS (SELECT *, strpos(t, 'rg') AS whole, strpos(t, 'r') AS one FROM l),
q AS (SELECT *, CASE WHEN one > 0 AND strpos(substr(t, one + 1), 'g') > 0 THEN one + strpos(substr(t, one + 1), 'g') ELSE 0 END AS two FROM p),
s AS (SELECT pos, label, CASE WHEN whole > 0 THEN 1001 - whole WHEN two > 0 THEN
  CASE WHEN one = 1 OR substr(t, one - 1, 1) IN (' ', '/', '-') THEN 6 ELSE 0 END + CASE WHEN one = 1 THEN 3 ELSE 1 END
  + CASE WHEN substr(t, two - 1, 1) IN (' ', '/', '-') THEN 6 ELSE 0 END + CASE WHEN two = one + 1 THEN 3 ELSE 1 END END AS score FROM q)
SELECT pos, label, CAST(score AS BIGINT) AS score FROM s WHERE score IS NOT NULL ORDER BY score DESC, pos LIMIT 40""")
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels against two letters that most hold apart from each other."""
    labels = derived.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("label"))
    return folders.palette(labels, "RG")


@query(with_notes("SELECT path, 'Doc ' || doc_id AS title, doc_id = 12 AS exact FROM notes WHERE contains('doc ' || doc_id, 'doc 12') ORDER BY lower('Doc ' || doc_id), path LIMIT 30"))
def picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.picker(derived.notes(spark, sf_dir), " Doc 12 ")


@query(with_notes(""", d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM notes),
t AS (SELECT *, split_part(folder, '/', 1) AS top FROM d),
r AS (SELECT folder, dense_rank() OVER (ORDER BY top) - 1 AS nth, row_number() OVER (PARTITION BY top ORDER BY folder) - 1 AS n FROM t)
SELECT folder, [205.0, 145, 332, 40, 265, 190, 355, 95, 22, 240, 170, 300][1 + nth % 12]::DOUBLE AS hue, 66.0::DOUBLE AS saturation, (46 + (n * 9) % 30)::DOUBLE AS light FROM r"""))
def folder_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.folder_colors(derived.notes(spark, sf_dir)).select("folder", "hue", "saturation", "light")


SEED = "33.0 * sqrt(count(*) OVER ()) * sqrt((row_number() OVER (ORDER BY path) - 0.5) / count(*) OVER ())"
ANGLE = "(row_number() OVER (ORDER BY path) - 1) * (pi() * (3 - sqrt(5)))"


@query(with_notes(f"SELECT path, round(cos({ANGLE}) * {SEED}, 4) + 0.0 AS x, round(sin({ANGLE}) * {SEED}, 4) + 0.0 AS y FROM notes"))
def layout_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = rewrite.numbered(derived.notes(spark, sf_dir).select("path"), "path", "i")
    placed = folders.seeds(nodes)
    return placed.select("path", (F.round("x", 4) + F.lit(0.0)).alias("x"), (F.round("y", 4) + F.lit(0.0)).alias("y"))


# --- import ----------------------------------------------------------------


def _sql_markdown(column: str) -> str:
    """The conversion chain as nested DuckDB calls, without images and block quotes."""
    out = column
    chain = [p for p in importing.BEFORE_QUOTES if "<img" not in p[0]] + list(importing.AFTER_QUOTES)
    for pattern, to in chain:
        to = to.replace("$1", "\\1").replace("$2", "\\2").replace("'", "''").replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    for name, sign in importing.ENTITIES:
        out = f"replace({out}, '{name.replace(chr(39), chr(39) * 2)}', '{sign.replace(chr(39), chr(39) * 2)}')"
    out = f"regexp_replace(regexp_replace({out}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({out}, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"WITH {POSTS_CTE} SELECT pos, {_sql_markdown('content_html')} AS markdown FROM posts")
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.posts(spark, sf_dir).select("pos", importing.to_markdown("content_html").alias("markdown"))


@query(f"""WITH {POSTS_CTE}, t AS (
  SELECT 'Kategorie' AS kind, category AS name, pos, title FROM posts UNION ALL SELECT 'Autor', author, pos, title FROM posts WHERE author <> '')
SELECT kind, name, regexp_replace(name, '[/\\\\:*?"<>|]', '-', 'g') AS stem, string_agg(title, '|' ORDER BY pos) AS titles FROM t GROUP BY kind, name""")
def import_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importing.hubs(derived.posts(spark, sf_dir)).select("kind", "name", "stem", F.array_join("titles", "|").alias("titles"))


@query(f"""WITH {POSTS_CTE} SELECT count(*) AS posts, (SELECT count(DISTINCT category) FROM posts) + (SELECT count(DISTINCT author) FROM posts WHERE author <> '') AS hubs,
count(DISTINCT nullif(author, '')) AS authors FROM posts""")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = derived.posts(spark, sf_dir)
    return importing.summary(posts, importing.notes_of(posts, "Blog"))


@query()
def import_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importing.notes_of(derived.posts(spark, sf_dir), "Blog")


IMPORT_CTE = f"""{POSTS_CTE},
hubs AS (SELECT DISTINCT category AS name FROM posts UNION SELECT DISTINCT author FROM posts WHERE author <> ''),
vault AS (
  SELECT 'mine/' || name || '.md' AS path, '# About ' || name || chr(10) || 'own words  ' || chr(10) AS content, false AS made FROM hubs WHERE length(name) % 3 = 0
  UNION ALL SELECT 'people/P ' || name || '.md', '# ' || upper(name) || chr(10) || '<!-- imported-start -->old<!-- imported-end -->' || chr(10) || 'after', false FROM hubs WHERE length(name) % 3 = 1
  UNION ALL SELECT 'Old/' || name || '.md', '---' || chr(10) || 'source: import' || chr(10) || '---' || chr(10) || name, true FROM hubs)"""


def _vault_of_hubs(posts: DataFrame) -> DataFrame:
    """Notes of the user's own under a hub's name or title, and old notes of an import, as in ``IMPORT_CTE``."""
    name, size = F.col("name"), F.length("name") % 3
    names = posts.select(F.explode(F.array(F.col("categories")[0], "author")).alias("name")).where("name <> ''").distinct()
    old = F.struct(F.concat(F.lit("Old/"), name, F.lit(".md")).alias("path"), F.concat(F.lit("---\nsource: import\n---\n"), name).alias("content"))
    mine = F.struct(F.concat(F.lit("mine/"), name, F.lit(".md")).alias("path"), F.concat(F.lit("# About "), name, F.lit("\nown words  \n")).alias("content"))
    titled = F.struct(F.concat(F.lit("people/P "), name, F.lit(".md")).alias("path"), F.concat(F.lit("# "), F.upper(name), F.lit(f"\n{importing.BLOCK_START}old{importing.BLOCK_END}\nafter")).alias("content"))
    return names.select(F.inline(F.when(size == 0, F.array(old, mine)).when(size == 1, F.array(old, titled)).otherwise(F.array(old))))


@query(f"""WITH {IMPORT_CTE},
t AS (SELECT 'Kategorie' AS kind, category AS name, pos, title FROM posts UNION ALL SELECT 'Autor', author, pos, title FROM posts WHERE author <> ''),
b AS (SELECT name, kind, '<!-- imported-start -->' || chr(10) || chr(10) || '## ' || name || ' · ' || count(*) || ' Beiträge' || chr(10) || chr(10)
  || string_agg('- [[' || CASE WHEN trim(title) = '' THEN 'Untitled' ELSE regexp_replace(trim(title), '[/\\\\:*?"<>|]', '-', 'g') END || ']]', chr(10) ORDER BY pos) || chr(10) || chr(10) || '<!-- imported-end -->' AS block FROM t GROUP BY name, kind),
k AS (SELECT name, arg_min(block, kind) AS block FROM b GROUP BY name),
s AS (SELECT pos, category, CASE WHEN trim(title) = '' THEN 'Untitled' ELSE trim(regexp_replace(trim(title), '[/\\\\:*?"<>|]', '-', 'g')) END AS stem FROM posts),
{FOLDED('s')}
SELECT 'Blog/' || CASE WHEN category = '' THEN '' ELSE category || '/' END || stems.stem || '.md' AS path, 'write' AS action, '' AS content FROM stems JOIN s USING (pos)
UNION ALL SELECT 'Blog/' || name || '.md', 'write', '' FROM b WHERE length(name) % 3 = 2
UNION ALL SELECT v.path, 'block', CASE WHEN starts_with(v.path, 'mine/') THEN '# About ' || name || chr(10) || 'own words' || chr(10) || chr(10) || block || chr(10)
  ELSE '# ' || upper(name) || chr(10) || block || chr(10) || 'after' END FROM vault v JOIN k ON v.path IN ('mine/' || name || '.md', 'people/P ' || name || '.md') WHERE NOT made
UNION ALL SELECT path, 'delete', '' FROM vault JOIN hubs ON path = 'Old/' || name || '.md' WHERE made AND length(name) % 3 < 2""")
def import_into_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import into a vault that has notes of its own and notes of an earlier import."""
    posts = derived.posts(spark, sf_dir)
    done = importing.import_into(_vault_of_hubs(posts), posts, "Blog")
    return done.select("path", "action", F.when(F.col("action") == "block", F.col("content")).otherwise("").alias("content"))


@query(f"""WITH {IMPORT_CTE}
SELECT DISTINCT author AS name, CASE length(author) % 3 WHEN 0 THEN 'mine/' || author || '.md' WHEN 1 THEN 'people/P ' || author || '.md' ELSE 'Blog/' || author || '.md' END AS path, length(author) % 3 < 2 AS merged
FROM posts WHERE author <> ''""")
def import_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = derived.posts(spark, sf_dir)
    return importing.import_report(_vault_of_hubs(posts), posts, "Blog")


# --- scalar functions ------------------------------------------------------


@query("""SELECT page_id, lower(rtrim(trim(url), '/')) AS link, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS url_path,
regexp_replace(url, '[/\\\\:*?"<>|]', '-', 'g') AS slug, regexp_replace(url, '/?[^/]*$', '') AS folder FROM pages""")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.table(spark, sf_dir, "pages")
    return pages.select("page_id", nm.normal_link("url").alias("link"), nm.url_path("url").alias("url_path"), nm.slug("url").alias("slug"), nm.folder("url").alias("folder"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS key, 'Basic ' || base64(encode(p_name || ':' || p_brand)) AS auth,
CASE WHEN p_size < 3 THEN '[[' || p_name || ']]' ELSE '[[' || p_name || '|' || p_brand || ']]' END AS markup FROM part""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derived.table(spark, sf_dir, "part")
    shown = F.when(F.col("p_size") < 3, F.upper("p_name")).otherwise(F.col("p_brand"))
    return part.select("p_partkey", nm.match_key("p_name").alias("key"), nm.basic_auth("p_name", "p_brand").alias("auth"), nm.link_markup("p_name", shown).alias("markup"))


@query(with_notes("""SELECT path, '---' || chr(10) || 'tags' || regexp_replace(regexp_replace(substr(content, 9), '(?m)^(author|ai_client):.*\\n', '', 'g'), '\\n---\\n', chr(10) || 'author: ai' || chr(10) || 'ai_client: scribe' || chr(10) || '---' || chr(10)) AS content FROM notes"""))
def ai_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.notes(spark, sf_dir).select("path", md.ai_stamp("content", "scribe").alias("content"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, '- ' || strftime(ts, '%H:%M') || ' ' || event_type AS line,
'# ' || event_type || ' on ' || strftime(ts, '%Y-%m-%d') || ' at ' || strftime(ts, '%H:%M') || ' {{other}}' AS filled FROM events""")
def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return events.select(
        "event_id", F.date_format("at", "yyyy-MM-dd").alias("day"), nm.capture_line(F.col("at"), "event_type").alias("line"),
        nm.template(F.lit("# {{ title }} on {{DATE}} at {{time}} {{other}}"), "event_type", F.col("at")).alias("filled"),
    )


@query(f"""WITH {B}, s AS (SELECT path, regexp_replace(content, '(?s)\\[\\[.*?\\]\\]', ' ', 'g') AS text FROM b)
SELECT path, len(regexp_extract_all(lower(text), '(?:^|[^\\pL\\pN_])license(?:$|[^\\pL\\pN_])'))::BIGINT AS n FROM s
WHERE regexp_matches(lower(text), '(?:^|[^\\pL\\pN_])license(?:$|[^\\pL\\pN_])')""")
def linked_mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = derived.notes(spark, sf_dir).where(F.lower("content").contains("license")).select("path", md.link_mentions("content", "License").alias("r"))
    return linked.where("r.n > 0").select("path", F.col("r.n").cast("long").alias("n"))


@query(f"WITH {B} SELECT path, 'Doc ' || doc_id AS target, 'Doc ' || doc_id AS label FROM b WHERE source = 'src7'")
def linked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dql.run(derived.notes(spark, sf_dir), "TABLE file.link WHERE source = src7").frame
    return rows.select("path", nm.link_cell(F.col("row")[0]).alias("cell")).select("path", "cell.target", "cell.label")


@query(with_notes("""SELECT path, CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f kB', floor(n / 1024.0 * 10 + 0.5) / 10) END AS size
FROM (SELECT path, strlen(content) AS n FROM notes)"""))
def note_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.notes(spark, sf_dir).select("path", nm.size_label(F.octet_length("content")).alias("size"))


DECODED = "replace({0}, '&amp;', '&')"


@query(f"""WITH {POSTS_CTE} SELECT pos, {DECODED.format('title')} AS title, link, 'A' || (pos % 5) AS author, category AS categories, 't' || (pos % 3) AS tags, md5(content_html) AS content FROM posts""")
def posts_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts written as the site's JSON, read back with titles decoded and authors looked up."""
    term = lambda name, kind: F.struct(F.lit(kind).alias("taxonomy"), name.alias("name"))
    page = derived.posts(spark, sf_dir).select(
        "pos",
        F.to_json(F.struct(
            F.struct(F.col("title").alias("rendered")).alias("title"), F.struct(F.col("content_html").alias("rendered")).alias("content"), "link", (F.col("pos") % 5).alias("author"),
            F.struct(F.array(F.array(term(F.col("categories")[0], "category")), F.array(term(F.concat(F.lit("t"), F.col("pos") % 3), "post_tag"))).alias("wp:term")).alias("_embedded"),
        )).alias("json"),
    )
    authors = spark.range(5).select("id", F.concat(F.lit("A"), "id").alias("name"))
    read = importing.posts_from_json(page, authors)
    return read.select("pos", "title", "link", "author", F.array_join("categories", "|").alias("categories"), F.array_join("tags", "|").alias("tags"), F.md5("content_html").alias("content"))


@query(f"WITH {POSTS_CTE} SELECT pos AS id, author AS name FROM posts WHERE pos <> 0")
def feed_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors that a feed names, found by the links of its items."""
    posts = derived.posts(spark, sf_dir)
    item = F.concat(F.lit("<item><link>"), F.upper(F.substring("link", 1, 5)), F.expr("substr(link, 6)"), F.lit("/</link><dc:creator><![CDATA[ "), "author", F.lit(" ]]></dc:creator></item>"))
    feeds = posts.groupBy((F.col("pos") % 7).alias("page")).agg(F.array_join(F.collect_list(item), "").alias("xml"))
    return importing.feed_authors(feeds, posts)


@query(f"""WITH {POSTS_CTE}, t AS (SELECT 'Kategorie' AS kind, category AS name, pos, title FROM posts UNION ALL SELECT 'Autor', author, pos, title FROM posts WHERE author <> '')
SELECT 'Blog/' || regexp_replace(name, '[/\\\\:*?"<>|]', '-', 'g') || '.md' AS path,
'---' || chr(10) || 'source: import' || chr(10) || '---' || chr(10) || chr(10) || '# ' || name || chr(10) || chr(10) || kind || ' mit ' || count(*) || ' Beiträgen:' || chr(10) || chr(10)
|| string_agg('- [[' || regexp_replace(trim(title), '[/\\\\:*?"<>|]', '-', 'g') || ']]', chr(10) ORDER BY pos) || chr(10) AS content
FROM t GROUP BY kind, name""")
def hub_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importing.notes_of(derived.posts(spark, sf_dir), "Blog").where("kind = 'hub'").select("path", "content")


@query("""SELECT p_partkey, list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(p_name, ''), lambda ch: ascii(ch)::HUGEINT)), lambda h, b: (h * 33 + b) % 18446744073709551616::HUGEINT)::VARCHAR AS hash,
'https://host/dav/' || replace(p_name, ' ', '%20') AS url FROM part""")
def remote_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derived.table(spark, sf_dir, "part")
    return part.select("p_partkey", nm.djb2("p_name").alias("hash"), nm.join_url(F.lit("https://host/dav/"), "p_name").alias("url"))


@query(f"""WITH {SNAPSHOTS_CTE}, k AS (SELECT * FROM snaps WHERE path <> 'u/2.md')
SELECT CASE WHEN path = 'u/1.md' THEN 'moved/1.md' ELSE path END AS path, count(*) AS n, max(taken_at) AS newest FROM k GROUP BY 1""")
def history_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note's history forgotten, another's moved along."""
    log = history.relocate(history.forget(derived.snapshots(spark, sf_dir), "u/2.md"), "u/1.md", "moved/1.md")
    return log.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("taken_at").alias("newest"))


@query(with_notes("""SELECT CASE WHEN doc_id = 5 THEN 'archive/Doc 5.md' ELSE path END AS path FROM notes"""))
def move_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.move(derived.notes(spark, sf_dir), _path_of(spark, sf_dir, 5), "/archive/").select("path")


@query(with_notes("""SELECT path, modified, length(content) AS n FROM notes WHERE doc_id >= 10
UNION ALL SELECT path, modified + 1, 3 FROM notes WHERE doc_id < 10
UNION ALL SELECT 'new.md', 0, 3"""))
def upsert_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = derived.notes(spark, sf_dir)
    few = notes.where(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") < 10).select("path", F.lit("new").alias("content"), (F.col("modified") + 1).alias("modified"))
    changes = few.unionByName(spark.range(1).select(F.lit("new.md").alias("path"), F.lit("new").alias("content"), F.lit(0).cast("long").alias("modified")))
    return rewrite.upsert(notes, changes).select("path", "modified", F.length("content").cast("long").alias("n"))


@query()
def layout_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions after two steps of the force layout."""
    notes = derived.notes(spark, sf_dir)
    nodes = rewrite.numbered(graph.nodes(notes).select("path"), "path", "i")
    return folders.layout(nodes, graph.pairs(notes), 2)


@query(r"""SELECT page_id, url NOT LIKE '%..%' AND NOT regexp_matches(url, '^[/\\]|^[A-Za-z]:') AS inside,
CASE WHEN regexp_matches(url, '^https?://') THEN rtrim(url, '/') END AS base, regexp_extract(url, '([^/]*)$', 1) AS name,
CASE WHEN regexp_matches(regexp_extract(url, '([^/]*)$', 1), '(?s)^.+\.[^.]*$') THEN regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\.([^.]*)$', 1) ELSE '' END AS ext,
regexp_extract(url, '([^/]*)$', 1) <> '' AND NOT starts_with(regexp_extract(url, '([^/]*)$', 1), '.') AND regexp_extract(url, '([^/]*)$', 1) NOT LIKE '%..%' AS plain FROM pages""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks on paths and names, over the addresses of all pages."""
    name = F.regexp_extract("url", r"([^/]*)$", 1)
    pages = derived.table(spark, sf_dir, "pages")
    return pages.select("page_id", nm.stays_inside("url").alias("inside"), nm.normal_base("url").alias("base"), name.alias("name"), nm.split_extension(name)["ext"].alias("ext"), nm.plain_file_name(name).alias("plain"))


@query(f"""WITH {B} SELECT path, 'Doc ' || doc_id AS title FROM b WHERE doc_id % 5 = 0""")
def dangling_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that link to some note which is not there."""
    notes = derived.notes(spark, sf_dir)
    lost = graph.resolved(notes).where("dst is null").select(F.col("src").alias("path")).distinct()
    return graph.meta(notes).join(lost, "path", "left_semi").select("path", "title")


@query("SELECT p_partkey, replace(p_name, 'e', '[e]') AS marked, len(string_split(p_name, 'e')) - 1 AS hits FROM part")
def highlighted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in parts, with what a search for a letter found in brackets."""
    parts = derived.table(spark, sf_dir, "part").select("p_partkey", search.highlighted("p_name", " E ").alias("parts"))
    shown = F.array_join(F.transform("parts", lambda p: F.when(p["hit"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"])), "")
    return parts.select("p_partkey", shown.alias("marked"), F.size(F.filter("parts", lambda p: p["hit"])).cast("long").alias("hits"))


@query(with_notes("SELECT path FROM notes WHERE starts_with(path, 'de/src3/')"))
def template_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.templates(derived.notes(spark, sf_dir), " de/src3 ").select("path")


@query(f"""WITH {B}, s AS (SELECT path, content, strpos(substr(content, 4), chr(10) || '---') + 3 AS shut FROM b),
e AS (SELECT *, strpos(substr(content, shut + 1), chr(10)) + shut AS stop FROM s)
SELECT path, substr(content, 1, stop) AS front, ltrim(substr(content, stop + 1), chr(10)) AS body,
  rtrim(substr(content, 1, stop), chr(10)) || chr(10) || chr(10) || ltrim(substr(content, stop + 1), chr(10)) AS joined,
  content AS unescaped FROM e""")
def split_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in block and body and together again, and with links that an editor escaped set right."""
    split = derived.notes(spark, sf_dir).withColumn("s", md.split_front("content"))
    escaped = F.replace(F.replace("content", F.lit("[["), F.lit(r"\[\[")), F.lit("]]"), F.lit(r"\]\]"))
    return split.select("path", "s.front", "s.body", md.join_front("s.front", "s.body").alias("joined"), md.unescaped_links(escaped).alias("unescaped"))


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'AI' WHEN user_id % 4 = 1 THEN 'Codex' WHEN user_id % 4 = 2 THEN 'Claude' ELSE event_type END AS client,
strftime(ts, '%d.%m., %H:%M') AS de, strftime(ts, '%d/%m, %H:%M') AS en FROM events""")
def review_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.table(spark, sf_dir, "events")
    client = F.element_at(F.array(F.lit(""), F.lit("CODEX"), F.lit("claude"), F.col("event_type")), (F.col("user_id") % 4 + 1).cast("int"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select("event_id", nm.client_label(client).alias("client"), nm.when_label(ms, "de").alias("de"), nm.when_label(ms, "en").alias("en"))


@query(with_notes(""", r AS (SELECT (length(content) - length(replace(content, 'Doc 1', ''))) // 5 AS n, contains('Doc ' || doc_id, 'Doc 1') AS renamed FROM notes)
SELECT count(*) FILTER (n > 0) AS hits, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (renamed) AS renames, count(*) FILTER (n > 0 OR renamed) AS affected FROM r"""))
def replace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.affected(derived.notes(spark, sf_dir), "Doc 1", "Page 1")


@query(with_notes("SELECT path, 'Doc ' || doc_id AS title FROM notes WHERE starts_with(path, 'de/src3/')"))
def deleted_with_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.deleted_with(derived.notes(spark, sf_dir), "/de/src3/")


@query("""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, ts, event_type FROM events),
g AS (SELECT day, string_agg('- ' || strftime(ts, '%H:%M') || ' ' || event_type, chr(10) || chr(10) ORDER BY ts, event_type) AS added,
  string_agg('- ' || strftime(ts, '%H:%M') || ' ' || event_type, chr(10) ORDER BY ts, event_type) AS old FROM e GROUP BY day)
SELECT 'Journal/' || day || '.md' AS path, CASE WHEN even THEN old ELSE '# ' || day END || chr(10) || chr(10) || added || chr(10) AS content, NOT even AS created
FROM (SELECT *, CAST(right(day, 1) AS INTEGER) % 2 = 0 AS even FROM g)""")
def captured_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events captured into daily notes, of which those of even days are there already."""
    events = derived.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("text"))
    rows = events.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("rows"))
    old = F.array_join(F.transform("rows", lambda r: nm.capture_line(r["at"], r["text"])), "\n")
    notes = rows.where(F.right("day", F.lit(1)).cast("int") % 2 == 0).select(F.concat(F.lit("Journal/"), "day", F.lit(".md")).alias("path"), F.concat(old, F.lit("\n")).alias("content"))
    return journal.capture(notes, events, "Journal")
