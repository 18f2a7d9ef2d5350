"""A corpus pipeline: quality rules, quality classifier, line dedup, near duplicates, packing.

``STAGES`` are (name, function) pairs; a function takes the session, the rows
that its predecessor kept, and the folder of the tables. All but the last
return the columns of ``documents``.

Defined results: stages keep rows with null texts only where their operator
does (the quality rules reject them); of rows that repeat a doc_id with equal
text one stays; without labels the classifier's scores are one half and every
document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm import jaccard, linedup, packing, quality, rules
from inkspark.llm._shared import cut, scratch_path
from inkspark.llm.queries import table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.judge(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the whole table, then judges what it is given."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("score") >= 0.7).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.drop_spread_lines(docs.select(*COLUMNS)).select(*COLUMNS[:-1], F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id."""
    found = cut(jaccard.near_duplicates(docs))
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"))
    repeated = stay.groupBy("_id").count().where("count > 1").limit(1).count()
    kept = docs.select(*COLUMNS).join(stay, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    if repeated:
        kept = kept.withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return kept


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, *vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Not expressible in SQL: robust estimates, a trained network, BPE and bin packing.
ORACLE_SQL = None
