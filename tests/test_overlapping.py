"""Equal rectangles meet once; every name of theirs is in the result."""

from gridspark.operators.filters import overlapping


def test_equal_rectangles(spark):
    kind = "{} int, crs string, xmin double, xmax double, ymin double, ymax double"
    domains = spark.createDataFrame([(k, " epsg:1", 0.0, 40.0, 0.0, 40.0) for k in range(30)] + [(99, "", 100.0, 101.0, 0.0, 1.0)], kind.format("domain"))
    runs = spark.createDataFrame([(k, "EPSG:1" if k < 20 else "EPSG:2", 1.0, 30.0, 1.0, 30.0) for k in range(40)], kind.format("run"))
    out = overlapping(domains, runs, 16.0)
    rows = out.collect()
    assert sorted((r.domain, r.run) for r in rows) == [(d, r) for d in range(30) for r in range(20)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Rectangles are made distinct before they are spread over bins.
    assert plan.count("Aggregate") == 2 and plan.count("Join") == 3
