"""Shared scratch space and lineage cuts.

Intermediate tables live in the folder that the cluster names in
``spark.checkpoint.dir``; only a session without one (tests) gets a folder of
its own.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, shared_dir

__all__ = ["cut", "drop", "heavy_keys", "scratch_path", "shared_dir", "store", "unique_join"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet below the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Keys that count as heavy hold at least this share of the rows, so there are at most ``1 / HEAVY`` of them.
HEAVY = 1 / 500


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that hold at least ``HEAVY`` of the rows that have one."""
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.select(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    return sizes.where(F.col("_n") >= F.greatest(total * HEAVY, F.lit(2))).select(key)


#: Rows of a few longs each up to which a stored table is broadcast whole (about two megabytes).
FEW = 20_000


def unique_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """Left join with ``right``, which has a row at most for each ``key``.

    A ``stored`` right side (cheap to count) of at most ``FEW`` rows is
    broadcast. With any other, rows whose key is heavy in ``left`` (at most 500
    keys) meet a broadcast, rows without a key meet nothing, and only the others
    are shuffled.
    """
    if stored and right.count() <= FEW:
        return left.join(F.broadcast(right), key, "left").select(*left.columns, *[c for c in right.columns if c != key])
    keys = (heavy_keys(left, key) if heavy is None else heavy).withColumnRenamed(key, "_key")
    some = right.join(F.broadcast(keys), F.col(key) == F.col("_key"), "left_semi")
    new = [c for c in right.columns if c != key]
    marked = left.join(F.broadcast(keys), F.col(key) == F.col("_key"), "left").withColumn("_heavy", F.col("_key").isNotNull()).drop("_key")
    order = [*left.columns, *new]
    bare = marked.where(F.col(key).isNull()).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in new])
    few = marked.where("_heavy").join(F.broadcast(some), key, "left").select(*order)
    rest = marked.where(~F.col("_heavy") & F.col(key).isNotNull()).join(right, key, "left").select(*order)
    return few.unionByName(rest).unionByName(bare)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session may have ended first; the folder is scratch space
        pass
