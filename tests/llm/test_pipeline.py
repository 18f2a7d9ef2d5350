"""The pipeline's stages on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from inkspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] > sizes[4] > 0
    left = docs.select("doc_id").distinct().count()
    assert left == sizes[4]


def test_empty_stages(spark):
    none = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_awkward_rows(spark):
    """Null and empty texts, null ids, repeated rows, a long text, and columns of clashing names, at every stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    one = docs.first().asDict()
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    schema = docs.schema
    rows = [one | {"doc_id": None}, one | {"text": None}, one | {"text": ""}, one, one, one | {"doc_id": 7001, "text": long}, one | {"doc_id": 7002, "lang": None, "source": None}, one | {"doc_id": 7003, "n_chars": None}]
    both = docs.unionByName(spark.createDataFrame([tuple(r[f] for f in schema.names) for r in rows], schema))
    for c in ("score", "kept", "line", "k", "list", "length", "size"):
        both = both.withColumn(c, F.lit("clash"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, both, DATA)
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS, name
        assert out.count() > 0, name
    kept = corpus_pipeline.near_duplicates(spark, both, DATA)
    assert kept.where("doc_id = 7001").count() == 1 and kept.groupBy("doc_id", "text").count().where("count > 1").count() == 0


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5
