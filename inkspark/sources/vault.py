"""Folders of markdown files as Spark tables: batch reader, writer, and stream.

``spark.dataSource.register(VaultSource)`` makes format ``vault`` available:

* read: a row (path, content, modified) for every ``.md`` file; names that
  begin with a dot are skipped with all below them, unreadable or non-UTF-8
  files are empty. Option ``table=folders`` gives the folders instead.
* write: a file for each row, with its folders; ``append`` keeps other files.
* stream: rows of files that are new or changed since the last offset, which
  is the newest modification time seen and the paths seen at it.

Spark's own text readers skip names that begin with ``_`` and empty files, so
they do not do.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, content string, modified bigint"
FILES_PER_PARTITION = 2000


def walk(root: str) -> Iterator[str]:
    """Relative paths of the notes below ``root``."""
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(f for f in folders if not f.startswith("."))
        for name in sorted(files):
            if not name.startswith(".") and os.path.splitext(name)[1] == ".md":
                yield os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")


def folders(root: str) -> list[str]:
    """Relative paths of all folders, empty ones too; assets and hidden ones are left out."""
    found = []
    for folder, below, _ in os.walk(root):
        below[:] = [f for f in below if not f.startswith(".") and f != "assets"]
        found += [os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in below]
    return sorted(found)


def load(root: str, path: str) -> tuple[str, str, int]:
    full = os.path.join(root, path)
    try:
        modified = os.stat(full).st_mtime_ns // 1_000_000
    except OSError:
        modified = 0
    try:
        with open(full, encoding="utf-8", newline="") as f:
            return path, f.read(), modified
    except (OSError, UnicodeDecodeError):
        return path, "", modified


def inside(root: str, path: str) -> str:
    """The full path of a note, which must lie below the root."""
    parts = path.replace("\\", "/").split("/")
    if path.startswith("/") or ".." in parts or os.path.isabs(path):
        raise ValueError(f"{path!r} leads out of the folder")
    return os.path.join(root, *parts)


@dataclass
class Files(InputPartition):
    paths: list[str]


class VaultReader(DataSourceReader):
    def __init__(self, root: str, table: str):
        self.root, self.table = root, table

    def partitions(self) -> list[Files]:
        if self.table == "folders":
            return [Files([])]
        paths = list(walk(self.root))
        return [Files(paths[i : i + FILES_PER_PARTITION]) for i in range(0, len(paths), FILES_PER_PARTITION)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        if self.table == "folders":
            yield from ((f,) for f in folders(self.root))
        else:
            yield from (load(self.root, p) for p in partition.paths)


class VaultWriter(DataSourceWriter):
    """Each file is written aside and moved into place, so a task that runs twice does no harm."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        attempt = f"{os.getpid()}"
        for row in rows:
            full = inside(self.root, row["path"])
            os.makedirs(os.path.dirname(full), exist_ok=True)
            aside = os.path.join(os.path.dirname(full), f".{os.path.basename(full)}.{attempt}")
            with open(aside, "w", encoding="utf-8", newline="") as f:
                f.write(row["content"] or "")
            os.replace(aside, full)
        return WriterCommitMessage()


class VaultStream(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def _times(self) -> dict[str, int]:
        found = {}
        for path in walk(self.root):
            try:
                found[path] = os.stat(os.path.join(self.root, path)).st_mtime_ns // 1_000_000
            except OSError:  # gone since the walk
                continue
        return found

    def initialOffset(self) -> dict:
        return {"at": "-1", "seen": "[]"}

    def latestOffset(self) -> dict:
        times = self._times()
        at = max(times.values(), default=-1)
        return {"at": str(at), "seen": json.dumps(sorted(p for p, t in times.items() if t == at))}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = int(start["at"]), int(end["at"])
        seen, last = set(json.loads(start["seen"])), set(json.loads(end["seen"]))
        paths = [p for p, t in self._times().items() if (t > low or t == low and p not in seen) and (t < high or t == high and p in last)]
        return [Files(paths[i : i + FILES_PER_PARTITION]) for i in range(0, len(paths), FILES_PER_PARTITION)]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from (load(self.root, p) for p in partition.paths)


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "folder string" if self.options.get("table") == "folders" else SCHEMA

    def reader(self, schema) -> VaultReader:
        return VaultReader(self.options["path"], self.options.get("table", "notes"))

    def writer(self, schema, overwrite: bool) -> VaultWriter:
        return VaultWriter(self.options["path"], overwrite)

    def streamReader(self, schema) -> VaultStream:
        return VaultStream(self.options["path"])


def save_asset(root: str, name: str, data: bytes) -> str:
    """Write bytes below ``assets`` under a free plain name; returns the relative path."""
    if not name or name.startswith(".") or any(s in name for s in ("/", "\\", "..")):
        raise ValueError(f"{name!r} is no plain file name")
    base, ext = os.path.splitext(name)
    os.makedirs(os.path.join(root, "assets"), exist_ok=True)
    chosen, n = name, 2
    while True:
        try:
            with open(os.path.join(root, "assets", chosen), "xb") as f:
                f.write(data)
            return f"assets/{chosen}"
        except FileExistsError:
            chosen, n = f"{base} {n}{ext}", n + 1
