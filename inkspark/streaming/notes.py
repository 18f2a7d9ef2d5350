"""Streams over notes: refresh from a folder, throttled snapshots, last write wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..lineage import numbers, remove
from ..operators.rewrite import upsert
from ..sources.vault import SCHEMA, VaultSource

REFRESH = "4 seconds"


def notes_stream(spark: SparkSession, root: str) -> DataFrame:
    """New and changed notes of a folder."""
    spark.dataSource.register(VaultSource)
    return spark.readStream.format("vault").load(root)


class Throttle(StatefulProcessor):
    """Keeps a snapshot where the last kept one of its note is old enough."""

    def __init__(self, seconds: int):
        self.step = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = self.last.get()
        last = state[0] if state else None
        for frame in rows:
            frame = frame.sort_values(["taken_at", "tie"])
            keep = []
            for at in frame["taken_at"]:
                due = last is None or at - last >= self.step
                keep.append(due)
                last = at if due else last
            if any(keep):
                yield frame[keep][["path", "taken_at", "tie"]]
        if last is not None:
            self.last.update((int(last),))

    def close(self) -> None:
        pass


def throttled_stream(log: DataFrame, seconds: int) -> DataFrame:
    """path, taken_at, tie of a snapshot stream under the minimum interval; needs the RocksDB state store."""
    return log.groupBy("path").transformWithStateInPandas(Throttle(seconds), "path string, taken_at bigint, tie bigint", "Append", "None")


def last_writes(batch: DataFrame) -> DataFrame:
    """The last content of each note in a batch (path, content, modified)."""
    return batch.groupBy("path").agg(F.max_by("content", F.struct("modified", "content")).alias("content"), F.max("modified").alias("modified"))


def kept_table(spark: SparkSession, path: str) -> DataFrame:
    """The current notes of a table that ``keep_table`` maintains."""
    whole = numbers(spark, f"{path}/whole")
    since = whole[-1] if whole else -1
    changes = [n for n in numbers(spark, f"{path}/changes") if n > since]
    notes = spark.read.schema(SCHEMA).parquet(f"{path}/whole/n={since}") if whole else spark.createDataFrame([], SCHEMA)
    if not changes:
        return notes
    rows = spark.read.schema(SCHEMA + ", n int").option("basePath", f"{path}/changes").parquet(*[f"{path}/changes/n={n}" for n in changes])
    latest = rows.groupBy("path").agg(F.max_by(F.struct("content", "modified"), "n").alias("last")).select("path", "last.*")
    return upsert(notes, latest) if whole else latest


def keep_table(stream: DataFrame, path: str, checkpoint: str, every: int = 50) -> StreamingQuery:
    """Maintain a table of current notes, read with ``kept_table``.

    A batch writes only what it changes, in a folder with its number, so one
    that runs again writes that folder again and nothing else. Each ``every``
    batches the whole table is written, and what came before the whole table
    before that goes: readers of the last one are not disturbed.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last_writes(batch).write.mode("overwrite").parquet(f"{path}/changes/n={number}")
        if (number + 1) % every == 0:
            before = numbers(spark, f"{path}/whole")
            if number not in before:
                kept_table(spark, path).write.mode("overwrite").parquet(f"{path}/whole/n={number}")
            for kind in ("whole", "changes"):
                for n in numbers(spark, f"{path}/{kind}"):
                    if before and (n < before[-1] or kind == "changes" and n == before[-1]):
                        remove(spark, f"{path}/{kind}/n={n}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def path_set_key(notes: DataFrame) -> DataFrame:
    """One value that changes when the set of paths does, and not with contents."""
    return notes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path").cast("decimal(38,0)")).alias("key"))
