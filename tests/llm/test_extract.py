"""The extractor: its reader of pages, its field against all label sequences, and held-out pages."""

from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.llm import extract, pagemaker
from inkspark.llm.queries import OP13_SQL, QUERIES


@pytest.fixture(scope="module")
def prose():
    rows = duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) BETWEEN 200 AND 4000 ORDER BY md5(doc_id::VARCHAR) LIMIT 500").fetchall()
    return [t for (t,) in rows]


@pytest.fixture(scope="module")
def model(prose):
    return extract.train(extract.labelled(prose, 500))


def texts(html):
    return [(b.text, b.around) for b in extract.leaf_blocks(html)]


def test_blocks():
    page = "<html><body><p>One <b>t</b>wo<br>three<p>four &amp; five&nbsp;&lt;<ul><li>a<li>b</ul><div class='x'>c<p>d</div>e</body>"
    assert texts(page) == [
        ("One two three", ("html", "body", "p")),
        ("four & five <", ("html", "body", "p")),
        ("a", ("html", "body", "ul", "li")),
        ("b", ("html", "body", "ul", "li")),
        ("c", ("html", "body", "div x")),
        ("d", ("html", "body", "div x", "p")),
        ("e", ("html", "body")),
    ]


def test_what_is_never_text():
    page = "<head><title>t</title><style>p{}</style></head><body><script>var t='</p>';</script><!-- c --><svg><text>s</text></svg><select><option>o</select><p>x<!-- -->y</p><noscript>n</noscript>"
    assert [t for t, _ in texts(page)] == ["xy"]


@pytest.mark.parametrize("page", ["", "<", "a < b & c", "<p", "<p class=\"x>text", "</p></div>x", "<!-- open", "<script>never ends", "<b><i>x</b></i>y", "\x00<p>퟿</p>", "<a href='1'>x<a href='2'>y", "&am &quot x &#x41; &#65"])
def test_broken_markup(page):
    extract.leaf_blocks(page)


def test_link_share():
    (b,) = extract.leaf_blocks("<p><a href='/'>linked</a> plain</p>")
    assert b.text == "linked plain" and b.linked == 6


def test_decoding_is_the_best_of_all(model):
    rng = np.random.default_rng(3)
    blocks = extract.leaf_blocks("<nav>a<p>b</p></nav><article><h1>C d.</h1><p>E f, g h.</p><p>x</p></article><div>" + "<p>Y z.</p>" * 3 + "</div>")
    for _ in range(20):
        m = extract.Model({f: float(rng.normal()) for page in extract.features(blocks) for f in page}, rng.normal(size=(3, 2, 2)))
        places = extract._places(blocks)

        def value(states):
            total = 0.0
            for i, b in enumerate(blocks):
                total += states[i] * m.score(b, places[i]) + (m.edges[extract._edge(blocks[i - 1], b), states[i - 1], states[i]] if i else 0.0)
            return total

        best = max(product((0, 1), repeat=len(blocks)), key=value)
        assert m.decode(blocks) == [bool(s) for s in best]


def test_training_raises_the_exact_likelihood():
    """Likelihoods by summing over all label sequences: the trained field beats perturbed ones."""
    pages = [[(b, keep) for b, keep in zip(extract.leaf_blocks(html), labels, strict=True)] for html, labels in (
        ("<nav>a b</nav><article><p>C d.</p><p>E f.</p></article><footer>g</footer>", (False, True, True, False)),
        ("<div class='menu'>x</div><div class='post'><p>Y z, w.</p></div>", (False, True)),
        ("<article><p>a.</p></article><p>b</p>", (True, True)),
    )]

    def loss(m):
        total = 0.0
        for page in pages:
            blocks = [b for b, _ in page]
            places = extract._places(blocks)

            def value(states, blocks=blocks, places=places):
                out = 0.0
                for i, b in enumerate(blocks):
                    out += states[i] * m.score(b, places[i]) + (m.edges[extract._edge(blocks[i - 1], b), states[i - 1], states[i]] if i else 0.0)
                return out

            z = np.logaddexp.reduce([value(s) for s in product((0, 1), repeat=len(blocks))])
            total += z - value(tuple(int(k) for _, k in page))
        size = sum(v * v for v in m.weights.values()) + (m.edges**2).sum()
        return total / sum(map(len, pages)) + 3e-2 / 2 * size

    m = extract.train(pages, steps=600, l2=3e-2, rate=0.05)
    least, rng = loss(m), np.random.default_rng(0)
    for _ in range(10):
        moved = extract.Model({f: v + rng.normal() * 0.05 for f, v in m.weights.items()}, m.edges + rng.normal(size=(3, 2, 2)) * 0.05)
        assert loss(moved) > least


def test_held_out_layouts(prose, model):
    hit = wrong = missed = 0
    for page in extract.labelled(prose, 200, seed=99):
        for got, (_, want) in zip(model.decode([b for b, _ in page]), page, strict=True):
            hit, wrong, missed = hit + (got and want), wrong + (got and not want), missed + (want and not got)
    assert hit / (hit + wrong) > 0.96 and hit / (hit + missed) > 0.96


def test_a_page_unlike_the_composed_ones(model):
    body = " ".join(["The council met on Tuesday to discuss the plan, which had been long in the making."] * 3)
    page = f"""<html><body><div id="cookie-consent"><p>We use cookies to make this site work. By going on you agree to their use.</p></div>
    <header><a href="/">Daily</a><nav><a href="/n">News</a> <a href="/s">Sport</a></nav></header>
    <main><article class="story"><h1>Council meets</h1><p>{body}</p><aside class="promo">Get our app today, it is free for all.</aside><p>{body}</p></article>
    <section class="comments"><h3>2 comments</h3><div class="comment"><p>I do not agree with this at all, the plan is bad.</p></div></section></main>
    <form><label>Mail</label><input><p>Sign up for our letter, it comes each week.</p></form><footer>&copy; Daily. All rights reserved.</footer></body></html>"""
    assert model.text(page) == f"Council meets\n{body}\n{body}"


def test_pages_of_the_tables(prose, model):
    for sf in ("sf0.001", "sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
        want = {r[0]: r[2] for r in con.execute(OP13_SQL).fetchall()}
        html = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
        assert {i: model.text(h) for i, h in html.items()} == want


def test_awkward_rows(spark, model):
    long = "<article>" + "".join(f"<p>Sentence {i} of a very long page, with words in it.</p>" for i in range(40_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", "no markup"), (4, "u", long), (5, "u", "<article><p>Same text, twice here.</p></article>"), (5, "u", "<article><p>Same text, twice here.</p></article>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars")})
    got = extract.extract(table, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 7
    found = {r.page_id: r for r in got.collect()}
    assert found[1].text == found[2].text == "" and found[2].n_chars == 0
    assert found[4].text.count("\n") == 39_999 and found[4].n_chars == len(found[4].text)
    assert got.where("page_id = 5 and text = 'Same text, twice here.'").count() == 2
    assert extract.extract(table.where("false"), model).count() == 0


def test_fit_without_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert extract.fit(none, pages=30).text("<nav><a href='/'>x</a></nav>") == ""
    assert extract.train([]).decode(extract.leaf_blocks("<p>x</p>")) == [False]


def test_composed_pages_are_the_same_each_time(prose):
    assert list(pagemaker.pages(prose, 5, 1)) == list(pagemaker.pages(prose, 5, 1))


def test_query(spark):
    out = QUERIES["op13_crf_extraction"](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(OP13_SQL).fetchall())
