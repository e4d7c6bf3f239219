"""Pairs of few rectangles with many names are unfolded by many tasks."""

from pyspark.sql import functions as F

from gridspark.operators.filters import overlapping


def test_pairs_are_dealt(spark):
    box = lambda df, name, n: df.select(F.col("id").alias(name), F.lit("").alias("crs"), *[(F.col("id") % n + d).cast("double").alias(c) for c, d in (("xmin", 0), ("xmax", 2), ("ymin", 0), ("ymax", 2))])
    out = overlapping(box(spark.range(400), "domain", 40), box(spark.range(60), "run", 3), 16.0)
    rows = out.collect()
    want = [(d, r) for d in range(400) for r in range(60) if abs(d % 40 - r % 3) < 2]
    assert sorted((r["domain"], r["run"]) for r in rows) == sorted(want)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1
