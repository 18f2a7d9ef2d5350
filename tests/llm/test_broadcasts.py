"""Small tables: near duplicates send few tables through the driver."""

from inkspark.llm import jaccard


def broadcasts(spark, run):
    """Broadcast stages in the plans that ``run`` executes."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    first = max([-1, *[store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]])
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = store.executionsList()
    plans = [made.apply(i).physicalPlanDescription() for i in range(made.size()) if made.apply(i).executionId() > first]
    return sum(p.split("== Initial Plan ==")[0].count("BroadcastQueryStage (") for p in plans)


def test_near_duplicates_broadcast_little(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    rows = list(enumerate(texts + [t + " more" for t in texts] + texts[:10]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {}
    made = broadcasts(spark, lambda: out.update((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect()))
    assert out == {i: i % 30 for i in range(70)}
    assert 0 < made <= 20
