"""Functions over note texts: small golden cases."""

import pytest
from pyspark.sql import functions as F

from inkspark.functions import markdown as md
from inkspark.functions import names as nm
from inkspark.operators import importing


@pytest.fixture
def value(spark):
    def run(expr, *texts):
        frame = spark.createDataFrame([texts or ("",)], ", ".join(f"c{i} string" for i in range(len(texts or ("",)))))
        return frame.select(expr.alias("v")).first()["v"]

    return run


def test_links(value):
    assert value(md.links("c0"), "See [[Alpha]] and [[Beta|the beta]] plus [[Gamma#section]] \\[\\[Delta\\]\\] [[ ]]") == ["Alpha", "Beta", "Gamma", "Delta"]
    assert value(md.links("c0"), "a [[ b") == []


def test_link_mentions(value):
    r = value(md.link_mentions("c0", "Ina Birk"), "ina birk, [[Ina Birk]] and Ina Birkner [[open Ina Birk")
    assert r["n"] == 1 and r["content"] == "[[ina birk]], [[Ina Birk]] and Ina Birkner [[open Ina Birk"


def test_mentions(value):
    assert value(md.mentions("c0", "Doc 1"), "doc 1, Doc 10, xDoc 1, DOC 1.") == 2
    assert value(md.without_links("c0"), "a [[b]] c [[d") == "a       c "


@pytest.mark.parametrize(
    ("content", "title"),
    [
        ("# My Idea\ntext", "My Idea"),
        ("{{title}}", "Stem"),
        ("", "Stem"),
        ("---\na: b\n---\n\n## - Head ", "- Head"),
        ("---\nnever closed\n# x", "Stem"),
        ("###\n> quoted", "quoted"),
        ("x" * 200, "x" * 120),
    ],
)
def test_title(value, content, title):
    assert value(md.title("c0", "c1"), "a/Stem.md", content) == title


def test_stamp(value):
    assert value(md.ai_stamp("c0", "scribe"), "---\nauthor: human\nk: v\n---\nx") == "---\nk: v\nauthor: ai\nai_client: scribe\n---\nx"
    assert value(md.ai_stamp("c0", "bad name"), "x") == "---\nauthor: ai\n---\n\nx"
    assert value(md.is_ai("c0"), '---\nauthor: "AI"\n---\n') is True
    assert value(md.ai_client("c0"), "---\nai_client: 'scribe'\n---\n") == "scribe"


def test_retarget(value):
    assert value(md.retarget("c0", "Old", "N$w"), "[[old]] [[Old|x]] [[ OLD#h]] [[Older]]") == "[[N$w]] [[N$w|x]] [[N$w#h]] [[Older]]"


def test_dice(value):
    assert abs(value(md.dice(F.col("c0"), F.col("c1")), "sourdogh", "sourdough") - 0.8) < 1e-9
    assert value(md.dice(F.col("c0"), F.col("c1")), "a", "b") == 0.0
    assert value(md.dice(F.col("c0"), F.col("c1")), "a", "a") == 1.0


def test_terms(value):
    assert value(md.terms("c0"), "The Größe_x of über is is1 bread bread") == ["größe_x", "is1", "bread", "bread"]
    assert sorted(value(md.significant_terms("c0"), "The Öl a_bc über bread")) == ["bread", "öl"]


def test_snippet(value):
    text = "a" * 50 + " needle " + "b" * 60
    assert value(md.snippet("c0", "NEEDLE"), text) == "…" + "a" * 29 + " needle " + "b" * 39 + "…"
    assert value(md.snippet("c0", "zzz"), "first\nsecond") == "first"


@pytest.mark.parametrize(("title", "want"), [("  My/Note:2  ", "My-Note-2"), ("  ", "Untitled"), ("a?b", "a-b")])
def test_slug(value, title, want):
    assert value(nm.slug("c0"), title) == want


def test_names(value):
    assert value(nm.clean_folder("c0"), " a/../b\\ c: / ") == "a/b/c-"
    assert value(nm.stays_inside("c0"), "a/../b") is False and value(nm.stays_inside("c0"), "a/b") is True
    assert value(nm.match_key("c0"), "A  b\tC") == "a b c"
    assert value(nm.basic_auth("c0", "c1"), "user", "pass") == "Basic dXNlcjpwYXNz"
    assert value(nm.url_segment("c0"), "a b~*ü+") == "a%20b~%2A%C3%BC%2B"
    assert value(nm.percent_decode("c0"), "a%20b+c") == "a b+c"
    assert value(nm.djb2("c0"), "hello") == "210714636441"
    assert value(nm.palette_score("c0", "nno"), "New Note") == 19
    assert value(nm.palette_score("c0", "note"), "New Note") == 996
    assert value(nm.palette_score("c0", "zz"), "New Note") is None
    assert value(nm.link_cell("c0"), "[[a|b]]") == ("a", "b")


def test_remote(value):
    xml = "<d:href>/dav/vault/</d:href><d:href>/dav/vault/Alpha.md</d:href><D:href>/dav/vault/notes/blue%20boat.md</D:href><d:href>/dav/vault/p.png</d:href><d:href>/dav/vault2/x.md</d:href>"
    assert value(nm.remote_notes("c0", "c1"), xml, "/dav/vault") == ["Alpha.md", "notes/blue boat.md"]


def test_html(value):
    html = '<h2>Hi</h2><p>a <b>b</b> <a href="u">c</a><img alt="x" src="y.png"></p><blockquote><p>q1\n q2</p></blockquote><ul><li>one</li></ul>Caf&#233; &amp;lt; Tee&#8230;<script>no</script>'
    assert value(importing.to_markdown("c0"), html) == "## Hi\n\na **b** [c](u)![x](y.png)\n\n> q1\n> q2\n\n- one\n\nCafé < Tee…"
    assert value(importing.decoded("c0"), "Caf&#233; &amp; Tee &#99999999999;") == "Café & Tee "
    assert value(importing.tag_text("c0", "dc:creator"), "<item><dc:creator><![CDATA[ Ann &amp; Bo ]]></dc:creator>") == "Ann & Bo"


def test_block(value):
    b = importing.BLOCK_START + "\nnew\n" + importing.BLOCK_END
    assert value(importing.with_block("c0", "c1"), "x\n", b) == "x\n\n" + b + "\n"
    assert value(importing.with_block("c0", "c1"), f"x {importing.BLOCK_START} old {importing.BLOCK_END} y", b) == f"x {b} y"
