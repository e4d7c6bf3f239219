"""A stream keeps the few state partitions it was started with, and the session keeps its own setting."""

from gridspark.streaming.run import run_available, read_cells, with_event_time


def test_partitions_of_a_stream(spark, tmp_path):
    spark.range(20).selectExpr("id", "cast(id as double) as t").write.parquet(str(tmp_path / "in"))
    stream = with_event_time(read_cells(spark, str(tmp_path / "in"), "id long, t double"), "5 seconds").dropDuplicatesWithinWatermark(["id"])
    run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"), partitions=3)
    assert len([p for p in (tmp_path / "state" / "state" / "0").iterdir() if p.name.isdigit()]) == 3
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8" and spark.read.parquet(str(tmp_path / "out")).count() == 20
