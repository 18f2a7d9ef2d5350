"""The folder source, the stream over it, and the vault's calls."""

import io
import json
import os

import pytest

from inkspark.operators.importing import pages_of_posts
from inkspark.sources.vault import VaultSource, save_asset
from inkspark.streaming.notes import keep_table, kept_table, last_writes, notes_stream, path_set_key, throttled_stream
from inkspark.vault import Endpoint, ReadOnly, Vault


@pytest.fixture
def root(tmp_path):
    files = {"A.md": "# Alpha\n[[b]] bee", "sub/_b.md": "", "sub/B.md": "see A today", ".hidden/x.md": "no", "sub/c.MD": "no", "assets/p.md": "yes"}
    for path, text in files.items():
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)
    (tmp_path / "sub/bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "empty").mkdir()
    return str(tmp_path)


def test_read(spark, root):
    spark.dataSource.register(VaultSource)
    rows = {r.path: r for r in spark.read.format("vault").load(root).collect()}
    assert set(rows) == {"A.md", "sub/_b.md", "sub/B.md", "sub/bad.md", "assets/p.md"}
    assert rows["sub/bad.md"].content == "" and rows["A.md"].modified > 0
    assert Vault(spark, root).list_folders() == ["empty", "sub"]


def test_write(spark, root):
    vault = Vault(spark, root)
    vault.write(spark.createDataFrame([("new/N.md", "text ü")], "path string, content string"))
    assert vault.read_note("new/N.md") == "text ü"
    with pytest.raises(Exception, match="leads out"):
        vault.write(spark.createDataFrame([("../N.md", "x")], "path string, content string"))
    with pytest.raises(ReadOnly):
        Vault(spark, root, allow_write=False).write_note("x.md", "")


def test_calls(spark, root):
    vault = Vault(spark, root)
    assert vault.create_note("sub", "B", "x", "scribe", ai=True) == "sub/B 2.md"
    assert vault.read_note("sub/B 2.md").startswith("---\nauthor: ai\nai_client: scribe\n")
    assert vault.rename_note("sub/B.md", "Bee") == ("sub/Bee.md", 1)
    assert vault.read_note("A.md") == "# Alpha\n[[Bee]] bee" and not os.path.exists(f"{root}/sub/B.md")
    assert vault.link_mentions("sub/Bee.md", "A") == 1 and vault.read_note("sub/Bee.md") == "see [[A]] today"
    first = vault.versions("sub/Bee.md")[-1]
    vault.restore("sub/Bee.md", first)
    assert vault.read_note("sub/Bee.md") == "see A today" and len(vault.versions("sub/Bee.md")) == 2
    assert vault.check_links("[[bee]] [[Beee]]") == {"resolved": ["bee"], "broken": [{"target": "Beee", "suggestions": ["Bee"]}]}
    vault.append_note("A.md", " more ")
    assert vault.read_note("A.md").endswith("bee\n\nmore\n")
    assert vault.delete_note("sub/Bee.md") == ["A.md"]
    assert save_asset(root, "i.png", b"1") == "assets/i.png" and save_asset(root, "i.png", b"2") == "assets/i 2.png"
    with pytest.raises(ValueError, match="plain"):
        save_asset(root, "../i.png", b"")


def test_more_calls(spark, root):
    vault = Vault(spark, root)
    assert vault.move_note("sub/B.md", "deep/er") == "deep/er/B.md" and vault.move_note("deep/er/B.md", "") == "B.md"
    assert [r.target for r in vault.outgoing("A.md").collect()] == ["b"] and vault.mentions("B.md").count() == 0
    assert vault.update_note("B.md", "[[a]]", "scribe")["resolved"] == ["a"] and "author: ai" in vault.read_note("B.md")
    assert vault.replace("Alpha", "Omega") == 1 and "Omega" in vault.read_note("A.md")
    vault.write_note("foo1.md", "first")
    vault.write_note("foo.md", "second")
    assert vault.replace("1", "", rename_notes=True) == 1
    assert vault.read_note("foo 2.md") == "first" and vault.read_note("foo.md") == "second" and not os.path.exists(f"{root}/foo1.md")
    assert vault.replace("A", "Z", rename_notes=True) >= 1 and os.path.exists(f"{root}/Z.md") and not os.path.exists(f"{root}/A.md")
    version = vault.snapshot("Z.md")
    vault.append_note("Z.md", "end")
    assert ("add", "end") in {r[1:] for r in vault.diff("Z.md", version)}
    assert vault.tree().count() == 2 and vault.calendar("Journal", 2024, 2).count() == 32
    nodes, edges = vault.graph()
    assert nodes.count() >= 4 and edges.count() >= 2


def test_import(spark, root):
    vault = Vault(spark, root)
    vault.write_note("me.md", "# Ann Lee\nabout me")
    vault.write_note("Blog/Ann Lee.md", "---\nsource: import\n---\n\n# Ann Lee")
    row = [(0, "First", "https://x/1", "", "Ann Lee", 1, "<p>hi</p>", ["News"], [])]
    posts = spark.createDataFrame(row, "pos long, title string, link string, date string, author string, author_id long, content_html string, categories array<string>, tags array<string>")
    for _ in range(2):  # a second run changes nothing
        done = vault.import_posts(posts, "Blog")
        assert done == {"notes": 2, "authors": ["Ann Lee"], "merged": ["Ann Lee → me.md"], "created": []}
        assert vault.read_note("me.md").count("## Ann Lee · 1 Beiträge") == 1 and not os.path.exists(f"{root}/Blog/Ann Lee.md")
    assert "*von [[me]]*" in vault.read_note("Blog/News/First.md")
    other = vault.import_posts(posts, "Blog", author_override="Bo", author_note="A.md")
    assert other["merged"] == ["Bo → A.md"] and "## Bo · 1 Beiträge" in vault.read_note("A.md")


def test_pages_of_posts():
    asked = []

    def site(sizes):
        def fetch(url):
            asked.append(url)
            n = len(asked) - 1
            return json.dumps([{"id": i} for i in range(sizes[n])]) if n < len(sizes) else None

        return fetch

    for sizes, total, calls in (([3, 3, 2], 8, 3), ([3, 0], 3, 2), ([3], 3, 2), ([3] * 60, 150, 50)):
        asked.clear()
        assert len(pages_of_posts(site(sizes), "https://x", size=3)) == total and len(asked) == calls


def test_endpoint(spark, root):
    end = Endpoint(Vault(spark, root, allow_write=False))
    assert json.loads(end.answer("{"))["error"]["code"] == -32700
    assert json.loads(end.answer('{"id": 1, "method": "no"}'))["error"]["code"] == -32601
    assert end.answer('{"method": "ping"}') is None
    assert len(json.loads(end.answer('{"id": 1, "method": "tools/list"}'))["result"]["tools"]) == 17
    tools = {t["name"]: t["inputSchema"] for t in json.loads(end.answer('{"id": 1, "method": "tools/list"}'))["result"]["tools"]}
    assert tools["related_notes"] == {"type": "object", "properties": {"path": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["path"]}
    out = io.StringIO()
    end.serve(['{"id": 7, "method": "ping"}\n', "\n", '{"method": "ping"}\n', "{\n"], out)
    assert [json.loads(x)["id"] for x in out.getvalue().splitlines()] == [7, None]
    call = {"id": 2, "method": "tools/call", "params": {"name": "read_note", "arguments": {"path": "A.md"}}}
    assert "Alpha" in json.loads(end.answer(json.dumps(call)))["result"]["content"][0]["text"]
    call["params"] = {"name": "create_folder", "arguments": {"name": "z"}}
    assert json.loads(end.answer(json.dumps(call)))["result"]["isError"]


def test_stream(spark, root, tmp_path_factory):
    out, check = str(tmp_path_factory.mktemp("out")), str(tmp_path_factory.mktemp("check"))
    for turn in range(5):
        if turn:
            with open(f"{root}/A.md", "w") as f:
                f.write(f"changed {turn}")
            os.utime(f"{root}/A.md", (2e9 + turn, 2e9 + turn))
        keep_table(notes_stream(spark, root), out, check, every=2).awaitTermination()
        now = {r.path: r.content for r in kept_table(spark, out).collect()}
        assert len(now) == 5 and (not turn or now["A.md"] == f"changed {turn}")
    assert sorted(os.listdir(f"{out}/whole")) == ["n=1", "n=3"] and sorted(os.listdir(f"{out}/changes")) == ["n=2", "n=3", "n=4"]
    assert spark.read.parquet(f"{out}/changes/n=4").count() == 1


def test_throttle_stream(spark, tmp_path):
    schema = "path string, taken_at bigint, tie bigint"
    rows = [("n", 0, 0), ("n", 500, 1), ("n", 1000, 2), ("n", 1900, 3), ("m", 5, 4)]
    spark.createDataFrame(rows[:2], schema).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    spark.createDataFrame(rows[2:], schema).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = throttled_stream(stream, 1).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = sorted(r.tie for r in spark.table("kept").collect())
    assert kept in ([0, 2, 4], [1, 3, 4], [2, 4])  # files may come in either order


def test_last_write_and_key(spark):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "x", 1)], "path string, content string, modified long")
    assert {r.path: r.content for r in last_writes(rows).collect()} == {"a": "2", "b": "x"}
    assert path_set_key(rows).first() == path_set_key(rows.selectExpr("path", "'z' AS content", "modified")).first()
