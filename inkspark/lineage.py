"""Where a session keeps checkpoints, and cutting a plan's lineage there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.

    Where none is named, a local session gets one of its own; on a cluster that
    would be a disk of the driver that executors do not see, so it is an error.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads survive the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder's path below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is written: its shuffle files go at its end, which else stay until the driver happens to collect its
#: garbage, and batches for Python are small, since rows here hold whole notes.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The session's settings for what runs within."""
    before = {name: spark.conf.get(name, None) for name in WRITING}
    try:
        for name, value in WRITING.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def stored(df: DataFrame, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a packed Parquet table and read it."""
    with writing(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
    return df.sparkSession.read.parquet(folder)


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete tables ``n=…`` below a folder, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path(folder)):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path(folder))]
    return sorted(int(n[2:]) for n in names if n.startswith("n=") and system.exists(path(f"{folder}/{n}/_SUCCESS")))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it is there."""
    old = spark._jvm.org.apache.hadoop.fs.Path(folder)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
