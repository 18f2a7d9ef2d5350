"""Operators on small vaults."""

import json
import random

from pyspark.sql import functions as F

from inkspark.operators import folders, graph, history, importing, rewrite, search

VAULT = (
    ("Hub.md", "# Hub\n[[A]] [[a]] [[Nowhere]] [[Hub]]"),
    ("x/A.md", "# Alpha\n[[hub|Hub]] [[nowhere]]"),
    ("x/B.md", "plain Hub and HUB, not Hubs [[Hubs]]"),
    ("Templates/T.md", "[[{{title}}]]"),
)


def test_graph(notes):
    frame = notes(*VAULT)
    edges = sorted((r.source, r.target) for r in graph.edges(frame, ["Templates"]).collect())
    assert edges == [("Hub.md", "missing:nowhere"), ("Hub.md", "x/A.md"), ("Hub.md", "x/A.md"), ("x/A.md", "Hub.md"), ("x/A.md", "missing:nowhere"), ("x/B.md", "missing:hubs")]
    nodes = {r.path: r for r in graph.nodes(frame, ["Templates"]).collect()}
    assert nodes["Hub.md"].degree == 4 and nodes["missing:nowhere"].title == "nowhere" and nodes["missing:nowhere"].missing
    assert [r.path for r in graph.backlinks_of(frame, "Hub.md").collect()] == ["x/A.md"]
    assert "missing:{{title}}" in {r.target for r in graph.edges(frame).collect()}


def test_duplicate_names_lead_to_the_last_by_title(notes):
    frame = notes(("a/N.md", "# Zebra"), ("b/N.md", "# Apple"), ("L.md", "[[n]]"))
    assert [r.target for r in graph.edges(frame).collect()] == ["a/N.md"]


def test_mentions(notes):
    frame = notes(*VAULT)
    found = search.unlinked_mentions(frame, "Hub.md", "Hub").collect()
    assert [(r.path, r["count"]) for r in found] == [("x/B.md", 2)]
    assert [(r.path, r.dst, r["count"]) for r in search.all_mentions(frame).collect()] == [("x/B.md", "Hub.md", 2)]
    assert search.unlinked_mentions(frame, "x/A.md", "A").count() == 0


def test_search(notes):
    frame = notes(("Recipes.md", "Bread"), ("Work.md", "part QX-77"))
    assert [r.path for r in search.search(frame, "/[A-Z]{2}-\\d{2}/").collect()] == ["Work.md"]
    assert search.search(frame, "/[/").count() == 0 and search.search(frame, "  ").count() == 0
    assert [r.path for r in search.search(frame, "RECIPES").collect()] == []
    assert [r.path for r in search.search(frame, "re:^bre").collect()] == []
    assert [r.path for r in search.search(frame, "/^bre/i").collect()] == ["Recipes.md"]
    assert search.classify("/a\\/b/x") == ("literal", "/a\\/b/x")


def test_highlighting_and_templates(spark, notes):
    rows = spark.createDataFrame([("Tea, TEA and teapot",), ("none",), ("a.b",)], "t string")
    parts = lambda sought: [[tuple(p) for p in r.p] for r in rows.select(search.highlighted("t", sought).alias("p")).collect()]
    assert parts("tea")[0] == [("Tea", True), (", ", False), ("TEA", True), (" and ", False), ("tea", True), ("pot", False)]
    assert parts("/[A-Z]{3}/")[0] == [("Tea, ", False), ("TEA", True), (" and teapot", False)]
    assert parts(".")[2] == [("a", False), (".", True), ("b", False)] and parts("  ")[1] == [("none", False)]
    frame = notes(("T/a.md", ""), ("T.md", ""), ("x/T/b.md", ""))
    assert [r.path for r in folders.templates(frame, "T").collect()] == ["T/a.md"] and folders.templates(frame, " ").count() == 0


def test_related_and_candidates(spark, notes):
    frame = notes(("Sourdough.md", "# Sourdough\nstarter flour water bread"), ("Rye.md", "rye bread flour oven"), ("Tax.md", "forms [[Sourdough]] income"))
    rows = search.related(frame, "Sourdough.md").collect()
    assert [r.path for r in rows] == ["Rye.md", "Tax.md"][: len(rows)] and not rows[0].linked
    texts = spark.createDataFrame([(1, "fresh bread and flour"), (2, "the of")], "id int, text string")
    assert [(r.id, r.path) for r in search.link_candidates(frame, texts, 1).collect()] == [(1, "Rye.md")]


def test_suggestions(spark):
    names = spark.createDataFrame([("Sourdough",), ("Taxes",), ("Sourdough Starter",)], "name string")
    lost = spark.createDataFrame([("Sourdogh",)], "target string")
    rows = search.suggestions(lost, names).orderBy("rank").collect()
    assert rows[0]["name"] == "Sourdough" and rows[0].score == 0.8


def test_rewrite(notes, spark):
    frame = notes(("a/Old.md", "x"), ("b.md", "[[old]] [[Old|al]] [[Old#s]]"))
    rows = {r.path: r for r in rewrite.rename(frame, "a/Old.md", "New: one").collect()}
    assert rows["b.md"].content == "[[New- one]] [[New- one|al]] [[New- one#s]]" and "a/New- one.md" in rows
    all_new = {r.path: r.content for r in rewrite.replace_all(frame.select("path", "content"), "Old", "New", True).collect()}
    assert all_new == {"a/New.md": "x", "b.md": "[[New]] [[New|al]] [[New#s]]"}
    met = notes(("n1.md", "one [[n]]"), ("n.md", "none [[n1^p]] [[N11|x]]"), ("n11.md", "eleven"), ("n 2.md", "[[n1#h]]"), ("z/n1.md", ""))
    got = {r.was: (r.path, r.content) for r in rewrite.replace_all(met.select("path", "content"), "1", "", True).collect()}
    assert got == {"n1.md": ("n 3.md", "one [[n]]"), "n.md": ("n.md", "none [[n 3^p]] [[n 4|x]]"), "n11.md": ("n 4.md", "eleven"), "n 2.md": ("n 2.md", "[[n 3#h]]"), "z/n1.md": ("z/n.md", "")}
    many = spark.range(3000).selectExpr("id AS pos", "'f' AS folder", "'Untitled' AS title")
    assert rewrite.free_paths(frame, many).select("path").distinct().count() == 3000
    wanted = spark.createDataFrame([(0, "a", "Old"), (1, "a", "Old"), (2, "", "b"), (3, "a", "Old 2")], "pos long, folder string, title string")
    assert {r.pos: r["path"] for r in rewrite.free_paths(frame, wanted).collect()} == {0: "a/Old 2.md", 1: "a/Old 3.md", 2: "b 2.md", 3: "a/Old 2 2.md"}
    changed = rewrite.upsert(frame, notes(("b.md", "new"), ("c.md", "y")))
    assert {r.path: r.content for r in changed.collect()} == {"a/Old.md": "x", "b.md": "new", "c.md": "y"}
    assert [r.path for r in rewrite.move(frame, "a/Old.md", "z").orderBy("path").collect()] == ["b.md", "z/Old.md"]
    for bad in (("", "x"), ("a", "a"), ("a", "a/b"), ("..", "x")):
        try:
            rewrite.move_folder(frame, *bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_history(spark):
    log = spark.createDataFrame([("n", 10, 0, "a"), ("n", 10, 1, "a"), ("n", 11, 2, "b"), ("n", 30, 3, "c"), ("m", 5, 4, "a")], "path string, taken_at long, tie long, content string")
    assert sorted((r.path, r.id) for r in history.distinct_ids(log).collect()) == [("m", 5), ("n", 10), ("n", 11), ("n", 12), ("n", 30)]
    assert sorted(r.tie for r in history.without_repeats(log).collect()) == [0, 2, 3, 4]
    assert sorted(r.tie for r in history.newest(log, 1).collect()) == [3, 4]
    assert [(r.taken_at, r.content) for r in history.restore(log, "n", 11, 99).orderBy("taken_at").collect()] == [(99, "c"), (100, "b")]


def longest(a, b):
    """Lines in common, by trying all ways."""
    if not a or not b:
        return 0
    return 1 + longest(a[1:], b[1:]) if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))


def test_diff(spark):
    assert history.diff_rows("a\nb\nc", "a\nx\nc") == [(0, "same", "a"), (1, "del", "b"), (2, "add", "x"), (3, "same", "c")]
    rng = random.Random(1)
    for _ in range(300):
        a, b = (["".join(rng.choice("abc")) for _ in range(rng.randint(0, 9))] for _ in range(2))
        rows = history.diff_rows("\n".join(a), "\n".join(b))
        assert [t for _, k, t in rows if k != "add"] == "\n".join(a).split("\n") and [t for _, k, t in rows if k != "del"] == "\n".join(b).split("\n")
        assert sum(k == "same" for _, k, _ in rows) == longest("\n".join(a).split("\n"), "\n".join(b).split("\n"))
    long = [str(i % 997) for i in range(20_000)]
    assert len(history.diff_rows("\n".join(long), "\n".join(long[5:] + ["end"]))) < 20_020
    pairs = spark.createDataFrame([(1, "a\nb", "b")], "id int, before string, after string")
    assert [(r.kind, r.text) for r in history.diffs(pairs).orderBy("pos").collect()] == [("del", "a"), ("same", "b")]


def test_import(spark):
    post = {"title": {"rendered": "Post &amp; A"}, "content": {"rendered": "<p>hi</p>"}, "link": "https://b/x/", "date": "2024", "author": 7,
            "_embedded": {"wp:term": [[{"taxonomy": "category", "name": "K"}, {"taxonomy": "post_tag", "name": "t"}]]}}
    rows = spark.createDataFrame([(0, json.dumps(post)), (1, json.dumps(post | {"author": 8}))], "pos long, json string")
    authors = spark.createDataFrame([(7, "Ann")], "id long, name string")
    posts = importing.posts_from_json(rows, authors)
    first = posts.where("pos = 0").first()
    assert (first.title, first.author, first.categories, first.tags) == ("Post & A", "Ann", ["K"], ["t"])
    made = {r.path: r.content for r in importing.notes_of(posts, "/Blog/").collect()}
    assert set(made) == {"Blog/K/Post & A.md", "Blog/K/Post & A 2.md", "Blog/K.md", "Blog/t.md", "Blog/Ann.md"}
    assert made["Blog/K/Post & A.md"] == "---\nsource: import\nurl: https://b/x/\ndate: 2024\n---\n\n# Post & A\n\n*von [[Ann]]*\n\nhi\n\n**Kategorien:** [[K]]\n\n**Tags:** [[t]]\n"
    assert made["Blog/K.md"].startswith("---\nsource: import\n---\n\n# K\n\nKategorie mit 2 Beiträgen:\n\n- [[Post & A]]\n")
    there = spark.createDataFrame([("k", "Old K")], "key string, stem string")
    assert "Blog/K.md" not in {r.path for r in importing.notes_of(posts, "Blog", there).collect()}
    feed = spark.createDataFrame([("<rss><item><link>https://B/x</link><dc:creator><![CDATA[Bo]]></dc:creator></item></rss>",)], "xml string")
    assert [(r.id, r.name) for r in importing.feed_authors(feed, posts).orderBy("id").collect()] == [(7, "Bo"), (8, "Bo")]


def test_layout(notes):
    frame = notes(("a.md", "[[b]]"), ("b.md", ""), ("c.md", ""))
    nodes = graph.nodes(frame).select("path").withColumn("i", F.rank().over(__import__("pyspark").sql.Window.orderBy("path")).cast("long") - 1)
    placed = folders.layout(nodes, graph.pairs(frame), 5).toPandas()
    assert len(placed) == 3 and abs(placed.x.mean()) < 1e-6 and placed.x.nunique() == 3
    assert folders.extent(folders.seeds(nodes)).first().min_x <= 0


def test_colors(notes):
    rows = {r.folder: r for r in folders.folder_colors(notes(("a/x.md", ""), ("a/b/y.md", ""), ("r.md", "")), {"a": "#ff0000"}).collect()}
    assert rows["a"].hue == 0.0 and rows["a/b"].light == 55.0 and rows[""].saturation == 8.0
    assert rows["a"].hex.startswith("#") and len(rows["a"].hex) == 7


def test_empty_tables(notes):
    frame = notes()
    assert graph.nodes(frame).count() == 0 and folders.tree(frame).count() == 0 and search.all_mentions(frame).count() == 0
