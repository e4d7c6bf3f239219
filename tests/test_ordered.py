"""Running values over equi-depth chunks against plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridspark.functions import ordered


def far(spark, n=4000):
    """A long series with one time far away, one of equal times, a short one and times that are missing."""
    rows = [("long", float(k), k) for k in range(n)] + [("long", 1e12, n)] + [("ties", float(k // 50), k) for k in range(1000)]
    rows += [("short", 1.0, 1), ("short", 2.0, None), ("gap", None, 5), ("gap", 3.0, 6), ("gap", float("nan"), 7)]
    return spark.createDataFrame(rows, "g string, t double, v long")


@pytest.mark.parametrize("rows", [100, 1000])
def test_chunks_hold_equally_many_rows(spark, rows):
    sizes = {(r.g, r._chunk): r["count"] for r in ordered.chunked(far(spark), ["g"], "t", rows).groupBy("g", "_chunk").count().collect()}
    each = [n for (g, _), n in sizes.items() if g == "long"]
    assert sum(each) == 4001 and len(each) >= 4000 // (2 * rows) and max(each) <= 2 * sum(each) / len(each)
    assert [n for (g, _), n in sizes.items() if g == "short"] == [2]


@pytest.mark.parametrize("rows", [7, 1000, 10 ** 6])
def test_running_values_equal_plain_windows(spark, rows):
    df = far(spark, 500).withColumn("u", F.monotonically_increasing_id())
    got = ordered.running(df, ["g"], ["t", "u"], {"s": ("sum", "v"), "l": ("last", "v")}, rows=rows, ahead={"n": ("last", "v"), "m": ("max", "v")})
    w, b = Window.partitionBy("g").orderBy("t", "u"), Window.partitionBy("g").orderBy(F.desc("t"), F.desc("u"))
    want = df.withColumns({"s": F.sum("v").over(w), "l": F.last("v", True).over(w), "n": F.last("v", True).over(b), "m": F.max("v").over(b.rowsBetween(Window.unboundedPreceding, 0))})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
