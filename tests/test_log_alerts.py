"""Alerts of many logs: state and rows of many logs travel together."""

from pyspark.sql import functions as F

from gridspark.operators.logs import FAILURES
from gridspark.streaming import monitors
from gridspark.streaming.run import read_cells, run_available


def test_many_logs_over_two_reads(spark, tmp_path):
    """Each of 300 logs has a failure text cut between two reads and repeated in the second; no call for each log."""
    mark = FAILURES[0]
    for n, (a, b) in enumerate((("ok\n", mark[:5]), (mark[5:] + "\n", mark))):
        rows = spark.range(300).select(F.format_string("r%d", "id").alias("run"), F.inline(F.array(
            F.struct(F.lit(2 * n + 1).cast("long").alias("seq"), F.lit(b).alias("text")), F.struct(F.lit(2 * n).cast("long").alias("seq"), F.lit(a).alias("text")))))
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = monitors.stream_log_alerts(read_cells(spark, str(tmp_path / "in"), rows.schema))
        assert "TransformWithState" not in stream._jdf.queryExecution().logical().toString()
        run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    assert sorted((r.run, r.seq, r.reason) for r in got) == sorted((f"r{k}", 2, mark) for k in range(300))
