"""What steps over small tables leave on disk and send around."""

import os
import random

from inkspark.lineage import shared_dir
from inkspark.llm import rules


def test_estimates_leave_few_files(spark):
    """Many shuffle partitions and few pools: what the steps of the estimates wrote is gone, or lies in few files."""
    few = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in few}
    folder = shared_dir(spark).removeprefix("file:")
    count = lambda: sum(len(names) for _, _, names in os.walk(folder))
    at_first = count()
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        rng = random.Random(5)
        texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(80)) for _ in range(40)]
        docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
        assert rules.judge(docs).where("kept").count() >= 30
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert count() - at_first < 48
