"""Bounded samples of labelled rows, and folds by document id.

Defined results: labels other than 0 and 1 and those without an id are not
used; empty tables give empty samples; a null id is in no fold; texts are
taken whole, null ones included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import store


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, folds: int, held_out: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """Texts and labels of at most ``per_class`` rows of each class, outside the held-out fold.

    Rows are taken in the order of a hash of their id, so the choice does not
    depend on partitioning. Also returns how many labelled rows each class has.
    A document with several equal labels counts once; one with contradicting
    labels is left out.
    """
    usable = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    sizes = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    ids = None
    for label in (0, 1):
        part = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(ids), "doc_id").repartition(8)  # at most 2 * per_class ids
    return store(chosen, "labelled")[0], sizes
