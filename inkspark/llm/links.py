"""Connected components of a link table, by minimum labels and pointer jumping.

Defined results: an empty table has no nodes; a link with a null end or from a
node to itself is no link; repeated links and links in both directions count
once; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, store


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); the root is the smallest node.

    Each round every node takes the smallest label around it and then its
    label's label; rounds grow with the logarithm of a component's diameter on
    usual graphs. Labels are written each round and the round before is
    deleted. A label that many nodes have is one long partition of two longs a
    node, which adaptive execution splits. The joins are merge joins at any
    size: a broadcast, however small its table, takes megabytes of the driver,
    and there would be two in every round.
    """
    spark = links.sparkSession
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both, both_path = store(ends.where("a <> b").distinct(), "links")
    labels, path = store(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root").hint("merge"), "b").select(F.col("a").alias("node"), "root", F.lit(None).cast(labels.schema["root"].dataType).alias("own"))
        lower = around.unionByName(labels.select("node", "root", F.col("root").alias("own"))).groupBy("node").agg(F.max("own").alias("root"), F.min("root").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("beyond")).hint("merge")
        moved, next_path = store(lower.join(jump, "to", "left").select("node", "root", F.least("to", F.coalesce("beyond", "to")).alias("next")), "labels")
        still = moved.where("root <> next").limit(1).count()
        drop(spark, path)
        labels, path = moved.select("node", F.col("next").alias("root")), next_path
        if not still:
            drop(spark, both_path)
            return labels
