"""WARC archives: writing with revisit records, reading, and a merged capture index.

*Writing.* Each page becomes a WARC/1.1 record whose payload is the page in
UTF-8 behind a short HTTP header. Of records with equal payloads of at least
``min_bytes`` bytes the one with the largest page_id is the response and the
others revisit it. A record is a gzip member of its own; a file is closed
before it exceeds ``file_bytes`` (a longer record is a file alone). Tasks write
to names that no other attempt uses and report what they have closed; only
files in that report are read, so a task that is lost or runs twice does no harm.

*Reading.* Files are read as streams, a record at a time. A payload's length
and digest are computed anew and must match the header; a revisit must name a
response with its digest and length. ``at`` is the place of the record's
member in the file, from which it can be read alone.

*Index.* Every archive yields a run of captures sorted by URL key, timestamp
and page. Runs are cut and dealt by range of that whole key, so no URL is too
hot; Spark's sort, which spills, brings the pieces of each run to a range in
order, and there a loser tree merges them as they stand in Arrow batches. The
rows come out in global order of (range, place).

Defined results: a null page is an empty payload; a null URL has the empty key
and no target line; a null page_id is never the response to others but of a
group that has only null ids all are responses; equal rows are alike: those
that equal the response in page_id and payload are responses too; an empty
table gives no archives and an empty index; a very long page is one record,
held once by its task; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, scratch_path, store, unique_join

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, at long"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 160-bit hexadecimal string, five hex digits to four signs."""
    value = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))

    def sign(v: Column, shift: int) -> Column:
        return F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))

    return F.array_join(F.transform(value, lambda v: F.concat(*[sign(v, s) for s in (15, 10, 5, 0)])), "")


#: Rows that revisit another, up to which they are broadcast (60 bytes each).
MAX_BROADCAST = 200_000


def files_at(path: str):
    """(file system, folder) of a path or URI, for tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = 1 << 26, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: Column | None = None) -> DataFrame:
    """Write one record for each row of ``pages`` below ``path``; archive, records and bytes of every file.

    ``captured`` is a timestamp; without one, captures are a second apart in
    the order of page ids, from 2024 on.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    when = captured if captured is not None else F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        html.alias("html"),
        F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        F.sha1(html.cast("binary")).alias("sha1"),
        F.octet_length(html).cast("long").alias("n"),
    )
    small = rows.where(F.col("n") >= min_bytes).select("page_id", "sha1")
    first = small.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and refers_to is not null")
    again = small.join(first, "sha1").where("page_id is null or page_id <> refers_to").select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "refers_to").distinct()
    again = cut(again)
    few = again.count() <= MAX_BROADCAST  # then pages are not shuffled
    both = rows.join(F.broadcast(again) if few else again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")), "left")
    line = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("n").cast("string"), F.lit(line * 2))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    url = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    record = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"),
        F.coalesce(F.concat(F.lit(f"{line}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{line}WARC-Date: "), F.col("captured"),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1")),
        F.coalesce(F.concat(F.lit(f"{line}WARC-Profile: {REVISIT}{line}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")), F.lit("")),
        F.lit(f"{line}X-Payload-Length: "), F.col("n").cast("string"),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "), block.cast("string"),
        F.lit(line * 2), http,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = files_at(path)
        files.create_dir(folder)
        done: list[tuple] = []
        out, name, n, size = None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None

        for batch in batches:
            for head, body in zip(batch.column(0), batch.column(1)):
                member = gzip.compress(f"{head.as_py()}{body.as_py()}\r\n\r\n".encode(), 2, mtime=0)
                if out is not None and size + len(member) > file_bytes:
                    close()
                if out is None:
                    name, n, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(member)
                n, size = n + 1, size + len(member)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    parts = both.select(record.alias("head"), F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("body"))
    return store(parts.mapInArrow(run, "archive string, records long, bytes long"), "archives")[0]


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, then path and query, in lower case."""
    if not url:
        return ""
    rest = url.strip().lower().partition("://")[2] or url.strip().lower()
    host, slash, path = rest.partition("/")
    host = host.partition("@")[2] or host
    name, _, port = host.partition(":")
    if name.startswith("www."):
        name = name[4:]
    return ",".join(reversed(name.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + slash + path


def records(source: bytes | io.IOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record of a plain or gzip archive, read as a stream.

    The offset is that of the record, in a gzip archive that of the member in
    which it begins.
    """
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    first = stream.read(1 << 18)
    inflate = zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None
    waiting, held, base = first, bytearray(), 0
    begun, taken = [(0, 0)], 0  # (place in the inflated text, place in the file) of members
    inflated = 0

    def more() -> bool:
        nonlocal waiting, inflate, taken, inflated
        part = waiting or stream.read(1 << 18)
        waiting = b""
        if not part:
            return False
        while part:
            text = inflate.decompress(part) if inflate else part
            held.extend(text)
            inflated += len(text)
            left = inflate.unused_data if inflate else b""
            taken += len(part) - len(left)
            if inflate and inflate.eof:
                inflate = zlib.decompressobj(31)
                begun.append((inflated, taken))
            part = left
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(held).strip():
                    raise ValueError("the archive ends within a record's headers")
                return
        first_line, *lines = held[:end].decode("utf-8").split("\r\n")
        if not first_line.startswith("WARC/"):
            raise ValueError(f"no WARC record at offset {base}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        stop = end + 4 + size
        while len(held) < stop + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {base} is not closed")
        while len(begun) > 1 and begun[1][0] <= base:
            begun.pop(0)
        yield (begun[0][1] if inflate else base), headers, bytes(held[end + 4 : stop])
        del held[: stop + 4]
        base += stop + 4


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def capture(offset: int, headers: dict[str, str], block: bytes, archive: str) -> tuple:
    """One row of ``CAPTURES``; a response's payload is measured, and held against its header."""
    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
    if headers["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, size):
            raise ValueError(f"payload of {headers['warc-record-id']} does not match its header")
    page = _page(headers["warc-record-id"])
    return url_key(headers.get("warc-target-uri")), headers["warc-date"], page, headers["warc-type"], _page(headers.get("warc-refers-to")), size, digest, archive, offset


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _batch(rows: list[tuple], *extra: pa.Array) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split(" ")[0] for c in CAPTURES.split(", ")]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)]
    return pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, *["range", "place"][: len(extra)]])


def read(archives: DataFrame, path: str) -> DataFrame:
    """Captures of the ``archives`` below ``path``; those of an archive are a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = files_at(path)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with files.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    rows = sorted((capture(*r, name) for r in records(stream)), key=_order)
                for at in range(0, len(rows), 5000):
                    yield _batch(rows[at : at + 5000])

    tasks = min(max(archives.count(), 1), 10_000)
    return archives.select("archive").repartition(tasks).mapInArrow(run, CAPTURES)


def checked(captures: DataFrame) -> DataFrame:
    """``captures``, whose revisits must name a response of their digest and length."""
    known = F.concat_ws(" ", F.col("page_id").cast("string"), "payload_digest", F.col("payload_bytes").cast("string"))
    named = F.when(F.col("record_type") == "revisit", F.concat_ws(" ", F.col("refers_to").cast("string"), "payload_digest", F.col("payload_bytes").cast("string")))
    there = captures.where("record_type = 'response' and page_id is not null").select(known.alias("named")).distinct().withColumn("found", F.lit(True))
    both = unique_join(captures.withColumn("named", named), there, "named")
    lost = F.col("named").isNotNull() & F.col("found").isNull()
    size = F.when(lost, F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without id")))).cast("long")).otherwise(F.col("payload_bytes"))
    return both.withColumn("payload_bytes", size).drop("named", "found")


class LoserTree:
    """k-way merge of sorted iterables: each inner node keeps the loser of its match."""

    def __init__(self, runs: list[Iterable[tuple]], key=_order):
        self.sources = [iter(r) for r in runs]
        self.key = key
        self.heads: list[tuple | None] = [None] * len(runs)
        self.keys: list[tuple] = [(True,)] * len(runs)
        for i in range(len(runs)):
            self._advance(i)
        self.losers = [-1] * len(runs)
        for i in range(len(runs) - 1, -1, -1):
            self._play(i)

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.sources[i], None)
        self.keys[i] = (True,) if self.heads[i] is None else (False, self.key(self.heads[i]))

    def _play(self, winner: int) -> None:
        """Carry a run from its leaf upward; an empty place keeps the first that comes."""
        node = (winner + len(self.sources)) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self.keys[other] < self.keys[winner]:
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.sources:
            return
        while self.heads[best := self.losers[0]] is not None:
            yield self.heads[best]
            self._advance(best)
            self._play(best)


def merged_index(captures: DataFrame, per_range: int = 200_000) -> DataFrame:
    """All captures in global order of (``range``, ``place``)."""
    captures = cut(captures)
    ranges = max(1, -(-captures.count() // per_range))

    def stream(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                yield from zip(*(c.to_pylist() for c in part.slice(at, 500).columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:  # archive by archive, in the order of the key
            names = batch.column("archive").dictionary_encode()
            code = names.indices.to_numpy()
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    runs.setdefault(names.dictionary[int(code[a])].as_py(), []).append(batch.slice(a, b - a))
        number, place, held = TaskContext.get().partitionId(), 0, []
        for row in LoserTree([stream(parts) for parts in runs.values()]):
            held.append(row)
            if len(held) == 5000:
                yield _batch(held, pa.array([number] * len(held), pa.int32()), pa.array(range(place, place + len(held)), pa.int64()))
                place, held = place + len(held), []
        if held:
            yield _batch(held, pa.array([number] * len(held), pa.int32()), pa.array(range(place, place + len(held)), pa.int64()))

    key = ["url_key", "captured", "page_id", "archive", "at"]
    dealt = captures.repartitionByRange(ranges, *key).sortWithinPartitions("archive", "url_key", "captured", "page_id", "at")
    return dealt.mapInArrow(run, CAPTURES + ", range int, place long")


def round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None, file_bytes: int = 1 << 26) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return the merged index."""
    path = path or scratch_path(pages.sparkSession, "warc")
    return merged_index(checked(cut(read(write(pages, path, min_bytes, file_bytes), path))))
