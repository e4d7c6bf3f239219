"""Files that tasks write in place."""

import os

from pyspark.sql import functions as F

from gridspark.sources import ranges, sinks


def test_files_span_batches_and_keep_their_order(spark, tmp_path):
    """Runs whose lines come in several batches, out of order; one run has a character that folders escape."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b:c").alias("run"), (-F.col("id")).alias("k"), F.col("id").cast("string").alias("text"))
        ranges.put_text(df, str(tmp_path), "run", F.lit("run.txt"), "k", header="head\n")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert (tmp_path / "run=a" / "run.txt").read_text().split() == ["head", *[str(k) for k in range(98, -1, -2)]]
    assert sorted(os.listdir(tmp_path)) == ["run=a", "run=b%3Ac"]
    rows = spark.read.option("header", True).csv(str(tmp_path))
    assert {r.run for r in rows.select("run").distinct().collect()} == {"a", "b:c"} and rows.count() == 100


def test_tracks_are_written_without_moving_files(spark, tmp_path):
    """One file of its own name for each storm, and none of an earlier write left."""
    df = spark.range(40).select((F.col("id") % 4).alias("storm"), F.col("id").cast("double").alias("seconds"), F.when(F.col("id") > 4, F.col("id") * 0.5).alias("lon"))
    path = str(tmp_path / "t")
    sinks.write_tracks(df.withColumn("storm", F.col("storm") + 10), path)
    sinks.write_tracks(df, path)
    assert sorted(os.listdir(path)) == [f"storm={k}" for k in range(4)]
    assert all(os.listdir(f"{path}/storm={k}") == ["track.csv"] for k in range(4))
    back = spark.read.option("header", True).schema("seconds double, lon double").csv(path)
    assert sorted((r.storm, r.seconds, r.lon or 0) for r in back.collect()) == sorted((r.storm, r.seconds, r.lon or 0) for r in df.collect())
