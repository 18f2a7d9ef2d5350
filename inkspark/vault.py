"""A folder of notes as one object: the calls that an agent or an application makes.

Reads are DataFrames. Writes go through the ``vault`` source and are refused
when the vault is opened for reading only.
"""

from __future__ import annotations

import inspect
import json
import os
import shutil
import time
from collections.abc import Callable, Iterable
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markdown as md
from .functions.names import clean_folder, stem
from .lineage import cut
from .operators import folders, graph, importing, rewrite, search
from .operators.history import diff_rows
from .plans import dql
from .sources.vault import VaultSource, inside


class ReadOnly(PermissionError):
    """A write to a vault that is open for reading only."""


class Vault:
    """Notes below ``root``; ``history`` names the hidden folder of snapshots."""

    def __init__(self, spark: SparkSession, root: str, allow_write: bool = True, history: str = ".history"):
        spark.dataSource.register(VaultSource)
        self.spark, self.root, self.allow_write = spark, root, allow_write
        self.history = os.path.join(root, history)

    def notes(self) -> DataFrame:
        return self.spark.read.format("vault").load(self.root)

    def list_notes(self, folder: str = "", recursive: bool = True) -> DataFrame:
        return graph.meta(folders.listing(self.notes(), folder, recursive)).orderBy(F.lower("title"), "path")

    def list_folders(self) -> list[str]:
        return [r.folder for r in self.spark.read.format("vault").option("table", "folders").load(self.root).collect()]

    def read_note(self, path: str) -> str:
        with open(inside(self.root, path), encoding="utf-8", newline="") as f:
            return f.read()

    def query(self, text: str) -> dql.Result:
        return dql.run(self.notes(), text)

    def search(self, text: str) -> DataFrame:
        return search.search(self.notes(), text)

    def backlinks(self, path: str) -> DataFrame:
        return graph.backlinks_of(self.notes(), path)

    def graph(self, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges."""
        return graph.nodes(self.notes(), exclude), graph.edges(self.notes(), exclude)

    def outgoing(self, path: str) -> DataFrame:
        return graph.outgoing(self.notes()).where(F.col("src") == path).orderBy("pos")

    def mentions(self, path: str) -> DataFrame:
        """Notes that name this one without linking to it."""
        return search.unlinked_mentions(self.notes(), path, path.rpartition("/")[2].removesuffix(".md"))

    def tree(self) -> DataFrame:
        return folders.tree(self.notes())

    def calendar(self, folder: str, year: int, month: int) -> DataFrame:
        return folders.month_grid(self.spark, self.notes(), folder, year, month).orderBy("cell")

    def replace_preview(self, find: str) -> DataFrame:
        return rewrite.replace_preview(self.notes(), find)

    def diff(self, path: str, version: str) -> list[tuple[int, str, str]]:
        """A snapshot against the present text, line by line."""
        with open(os.path.join(self.history, path, f"{int(version)}.md"), encoding="utf-8", newline="") as f:
            return diff_rows(f.read(), self.read_note(path))

    def related(self, path: str, limit: int = 8) -> DataFrame:
        return search.related(self.notes(), path, limit)

    def candidates(self, text: str, limit: int = 8) -> DataFrame:
        return search.link_candidates(self.notes(), self.spark.createDataFrame([(0, text)], "id int, text string"), limit)

    def check_links(self, text: str) -> dict[str, Any]:
        """Links of a text that lead somewhere, and those that do not, with likely names."""
        asked = self.spark.createDataFrame([(text,)], "content string").select(F.posexplode(md.links("content")).alias("pos", "target"))
        names = self.notes().select(stem("path").alias("name"))
        known = asked.join(names.select(F.lower("name").alias("key"), F.lit(True).alias("known")).distinct(), F.lower("target") == F.col("key"), "left")
        rows = known.orderBy("pos").collect()
        lost = self.spark.createDataFrame([(r.target,) for r in rows if not r.known] or [("",)], "target string")
        near: dict[str, list[str]] = {}
        for r in search.suggestions(lost, names).orderBy("rank").collect():
            near.setdefault(r.target, []).append(r["name"])
        return {"resolved": [r.target for r in rows if r.known], "broken": [{"target": r.target, "suggestions": near.get(r.target, [])} for r in rows if not r.known]}

    # --- writes ------------------------------------------------------------

    def _ensure_write(self) -> None:
        if not self.allow_write:
            raise ReadOnly("this vault is open for reading only")

    def write(self, rows: DataFrame) -> None:
        """Write (path, content) rows as files."""
        self._ensure_write()
        rows.select("path", "content").write.format("vault").mode("append").save(self.root)

    def write_note(self, path: str, content: str) -> None:
        self._ensure_write()
        full = inside(self.root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8", newline="") as f:
            f.write(content)

    def create_note(self, folder: str, title: str, content: str, client: str | None = None, ai: bool = False) -> str:
        """A new note under a free name; an assistant's is stamped."""
        self._ensure_write()
        rows = self.spark.createDataFrame([(0, folder, title, content)], "pos long, folder string, title string, content string")
        path = rewrite.free_paths(self.notes(), rows).first()["path"]
        if ai:
            content = rows.select(md.ai_stamp("content", client).alias("c")).first()["c"]
        self.write_note(path, content)
        return path

    def append_note(self, path: str, text: str) -> None:
        old = self.read_note(path) if os.path.exists(inside(self.root, path)) else ""
        self.write_note(path, (old.rstrip() + "\n\n" if old.strip() else "") + text.strip() + "\n")

    def rename_note(self, path: str, title: str) -> tuple[str, int]:
        """Rename within the folder with link repair: the new path, and how many notes changed."""
        self._ensure_write()
        notes, (folder, _, _) = self.notes(), path.rpartition("/")
        row = self.spark.createDataFrame([(0, folder, title)], "pos long, folder string, title string")
        new = rewrite.free_paths(notes.where(F.col("path") != path), row).first()["path"]
        name = new.rpartition("/")[2].removesuffix(".md")
        changed = cut(rewrite.rename(notes, path, name).where("changed").select("path", "content"))
        os.replace(inside(self.root, path), inside(self.root, new))
        self.write(changed)
        self._move_history(path, new)
        return new, changed.count()

    def _move_history(self, old: str, new: str | None) -> None:
        """Snapshots follow a note, or go with it."""
        here = os.path.join(self.history, old)
        if os.path.isdir(here) and old != new:
            if new is None:
                shutil.rmtree(here)
            else:
                os.makedirs(os.path.dirname(os.path.join(self.history, new)), exist_ok=True)
                shutil.rmtree(os.path.join(self.history, new), ignore_errors=True)
                os.replace(here, os.path.join(self.history, new))

    def move_note(self, path: str, folder: str) -> str:
        """Move a note under a free name; links follow its stem and need no repair."""
        self._ensure_write()
        row = self.spark.createDataFrame([(0, folder, path.rpartition("/")[2].removesuffix(".md"))], "pos long, folder string, title string")
        new = rewrite.free_paths(self.notes().where(F.col("path") != path), row).first()["path"]
        os.makedirs(os.path.dirname(inside(self.root, new)), exist_ok=True)
        os.replace(inside(self.root, path), inside(self.root, new))
        self._move_history(path, new)
        return new

    def move_folder(self, folder: str, into: str) -> str:
        """Move a folder with all it holds, and its notes' snapshots; its new path. Nothing is merged or replaced."""
        self._ensure_write()
        source, to = rewrite.folder_target(folder, into)
        if not os.path.isdir(inside(self.root, source)):
            raise FileNotFoundError(f"no folder {source}")
        if to == source:
            return to
        if os.path.exists(inside(self.root, to)):
            raise FileExistsError(f"there is a folder {to}")
        os.makedirs(os.path.dirname(inside(self.root, to)), exist_ok=True)
        os.replace(inside(self.root, source), inside(self.root, to))
        self._move_history(source, to)
        return to

    def update_note(self, path: str, content: str, client: str | None = None) -> dict[str, Any]:
        """An assistant's new text for a note: stamped, written, its links checked."""
        self._ensure_write()
        rows = self.spark.createDataFrame([(content,)], "content string").select(md.ai_stamp("content", client).alias("c"))
        self.write_note(path, rows.first()["c"])
        return self.check_links(content)

    def replace(self, find: str, replacement: str, rename_notes: bool = False) -> int:
        """Replace a text everywhere, with renames if asked for; how many notes changed."""
        self._ensure_write()
        if not find:
            return 0
        old = self.notes().select(F.col("path").alias("was"), F.col("content").alias("text"))
        new = rewrite.replace_all(self.notes().select("path", "content"), find, replacement, rename_notes)
        # written aside first, as a note may take the path of one that moves on
        changed = cut(new.join(old, "was").where("path <> was or content <> text").select("was", "path", "content"))
        moved = changed.where("path <> was").select("was", "path").collect()
        self.write(changed)
        kept = {r.path for r in moved}
        for r in moved:
            if r.was not in kept:
                os.remove(inside(self.root, r.was))
        aside = [(r, os.path.join(self.history, f".moving-{i}")) for i, r in enumerate(moved) if os.path.isdir(os.path.join(self.history, r.was))]
        for r, held in aside:
            os.replace(os.path.join(self.history, r.was), held)
        for r, held in aside:
            os.makedirs(os.path.dirname(os.path.join(self.history, r.path)), exist_ok=True)
            os.replace(held, os.path.join(self.history, r.path))
        return changed.count()

    def import_posts(self, posts: DataFrame, folder: str, author_override: str = "", author_note: str = "") -> dict[str, Any]:
        """Bring posts into the vault: notes and hubs written, lists put into notes of one's own, superseded notes deleted."""
        self._ensure_write()
        report = importing.import_report(self.notes(), posts, folder, author_override, author_note).orderBy("name").collect()
        done = cut(importing.import_into(self.notes(), posts, folder, author_override, author_note))
        self.write(done.where("action <> 'delete'"))
        for r in done.where("action = 'delete'").select("path").collect():
            os.remove(inside(self.root, r.path))
        counts = {r.action: r["count"] for r in done.groupBy("action").count().collect()}
        lines = lambda merged: [f"{r['name']} → {r.path}" for r in report if r.merged == merged]
        return {"notes": counts.get("write", 0), "authors": [r["name"] for r in report], "merged": lines(True), "created": lines(False)}

    def delete_note(self, path: str) -> list[str]:
        """Delete a note; the notes whose links break by it."""
        self._ensure_write()
        broken = [r.path for r in graph.deletion_report(self.notes(), path).collect()]
        os.remove(inside(self.root, path))
        self._move_history(path, None)
        return broken

    def delete_folder(self, name: str) -> None:
        self._ensure_write()
        if not name.strip("/"):
            raise ValueError("the root cannot be deleted")
        shutil.rmtree(inside(self.root, name.strip("/")))

    def create_folder(self, name: str) -> str:
        """Make a folder, each part of its name cleaned of signs that no file may have; its path."""
        self._ensure_write()
        clean = self.spark.range(1).select(clean_folder(F.lit(name)).alias("name")).first()["name"]
        if not clean:
            raise ValueError("a folder needs a name")
        os.makedirs(inside(self.root, clean), exist_ok=True)
        return clean

    def link_mentions(self, path: str, name: str) -> int:
        """Turn a note's plain mentions of a name into links, after a snapshot."""
        self._ensure_write()
        self.snapshot(path)
        rows = self.spark.createDataFrame([(self.read_note(path),)], "content string").select(md.link_mentions("content", name).alias("r"))
        found = rows.first()["r"]
        if found["n"]:
            self.write_note(path, found["content"])
        return found["n"]

    def snapshot(self, path: str) -> str | None:
        """Keep the note's text if it differs from the newest snapshot; its id."""
        self._ensure_write()
        text, folder = self.read_note(path), os.path.join(self.history, path)
        ids = sorted((int(f.removesuffix(".md")) for f in os.listdir(folder)), reverse=True) if os.path.isdir(folder) else []
        if ids:
            with open(os.path.join(folder, f"{ids[0]}.md"), encoding="utf-8", newline="") as f:
                if f.read() == text:
                    return None
        os.makedirs(folder, exist_ok=True)
        at = max(int(time.time() * 1000), ids[0] + 1 if ids else 0)
        with open(os.path.join(folder, f"{at}.md"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
        for old in ids[49:]:
            os.remove(os.path.join(folder, f"{old}.md"))
        return str(at)

    def versions(self, path: str) -> list[str]:
        folder = os.path.join(self.history, path)
        return sorted((f.removesuffix(".md") for f in os.listdir(folder)), key=int, reverse=True) if os.path.isdir(folder) else []

    def restore(self, path: str, version: str) -> None:
        """Bring an old text back, keeping the present one as a snapshot first."""
        self._ensure_write()
        if not (version.isascii() and version.isdigit()):
            raise ValueError("no such version")
        with open(os.path.join(self.history, path, f"{version}.md"), encoding="utf-8", newline="") as f:
            text = f.read()
        self.snapshot(path)
        self.write_note(path, text)


def schema_of(tool: Callable) -> dict[str, Any]:
    """JSON schema of a tool's arguments, from its signature: those without a default are required."""
    kinds = {bool: "boolean", int: "integer"}
    args = inspect.signature(tool).parameters.values()
    shown = {a.name: {"type": kinds.get(type(a.default), "string")} for a in args}
    return {"type": "object", "properties": shown, "required": [a.name for a in args if a.default is a.empty]}


class Endpoint:
    """JSON-RPC requests, one to a line, over a vault."""

    def serve(self, requests: Iterable[str], out: TextIO) -> None:
        """Answer lines until there are no more; blank ones are passed over."""
        for line in requests:
            if line.strip() and (answer := self.answer(line)) is not None:
                out.write(answer + "\n")
                out.flush()

    def __init__(self, vault: Vault):
        rows = lambda frame: [r.asDict() for r in frame.collect()]
        self.tools = {
            "list_notes": lambda folder="", recursive=True: rows(vault.list_notes(folder, recursive)),
            "list_folders": vault.list_folders,
            "read_note": vault.read_note,
            "search_notes": lambda query: rows(vault.search(query)),
            "list_backlinks": lambda path: rows(vault.backlinks(path)),
            "list_outgoing_links": lambda path: rows(vault.outgoing(path)),
            "unlinked_mentions": lambda path: rows(vault.mentions(path)),
            "related_notes": lambda path, limit=8: rows(vault.related(path, limit)),
            "find_link_candidates": lambda text, limit=8: rows(vault.candidates(text, limit)),
            "create_note": lambda title, content, folder="", client=None: {"path": vault.create_note(folder, title, content, client, ai=True)} | vault.check_links(content),
            "update_note": vault.update_note,
            "move_note": vault.move_note,
            "rename_note": vault.rename_note,
            "delete_note": vault.delete_note,
            "create_folder": vault.create_folder,
            "delete_folder": vault.delete_folder,
            "link_mentions": vault.link_mentions,
        }

    def answer(self, line: str) -> str | None:
        """The response to one request; None for a notification."""
        try:
            request = json.loads(line)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
        if "id" not in request:
            return None
        match request.get("method"):
            case "initialize":
                result: Any = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "inkspark", "version": "1"}}
            case "ping":
                result = {}
            case "tools/list":
                result = {"tools": [{"name": n, "inputSchema": schema_of(f)} for n, f in self.tools.items()]}
            case "tools/call":
                params = request.get("params", {})
                try:
                    value = self.tools[params["name"]](**params.get("arguments", {}))
                    result = {"content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False)}], "isError": False}
                except Exception as problem:  # a tool's failure is its answer
                    result = {"content": [{"type": "text", "text": f"{type(problem).__name__}: {problem}"}], "isError": True}
            case _:
                return json.dumps({"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": "method not found"}})
        return json.dumps({"jsonrpc": "2.0", "id": request["id"], "result": result}, ensure_ascii=False)
