"""Rows without some ids: most rows stay where they are."""

from pyspark.sql import functions as F

from gridspark.llm import jaccard
from gridspark.llm.common import without_ids


def moved_rows(plan) -> int:
    """Rows that all shuffles of an executed plan wrote."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return moved_rows(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return moved_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(moved_rows(plan.children().apply(k)) for k in range(plan.children().size()))


def test_rows_that_stay_do_not_move(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")).unionByName(
            spark.createDataFrame([(None, "x"), (7, "again")], "doc_id long, text string"))
        out = without_ids(rows, spark.createDataFrame([(7,), (70,), (9999,)], "doc_id long"), "doc_id")
        got = out.collect()
        assert out.columns == ["doc_id", "text"]
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in got) == [-1, *(k for k in range(5000) if k not in (7, 70))]
        assert moved_rows(out._jdf.queryExecution().executedPlan()) < 100
        words = [f"word{k}" for k in range(30)]
        docs = spark.createDataFrame([(k, " ".join([*words, str(k // 2 * 1000 if k < 10 else "")]), k) for k in range(10)] + [(k, f"other {k} " * 3, k) for k in range(100, 400)], "doc_id long, text string, extra int")
        kept = jaccard.one_per_group(docs)
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.collect()}
        assert ids == {0, *range(100, 400)}
        assert moved_rows(kept._jdf.queryExecution().executedPlan()) < 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
