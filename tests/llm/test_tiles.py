"""Rows that meet in the tiles of the similarity join."""

from plan_rows import joined_rows
from pyspark.sql import functions as F

from gridspark.llm import jaccard


def test_altered_copies_do_not_meet_in_pairs(spark):
    """200 sets of 100 shingles, each with 13 of its own before 8 that all share, cannot reach four fifths."""
    rows = spark.range(200).select(F.col("id"), F.lit(100).alias("n"), F.posexplode(F.sequence(F.lit(13), F.lit(20))).alias("k", "at"))
    rows = rows.select(F.col("at").cast("long").alias("key"), "id", "n", "at", F.col("id").alias("label"), F.lit(0).cast("long").alias("main"))
    out = jaccard.tile_pairs(rows, 80)
    assert out.collect() == []
    assert joined_rows(out._jdf.queryExecution().executedPlan()) < 200


def test_places_that_just_reach(spark):
    """Sets of 90 with a first common shingle at place 10 share 80 of 100 at most; at place 11 they cannot."""
    given = [(1, 1, 90, 10, 1, 9), (1, 2, 90, 10, 2, 9), (2, 3, 90, 11, 3, 9), (2, 4, 90, 10, 4, 9), (3, 5, 100, 20, 5, 9), (3, 6, 80, 0, 9, 9)]
    out = jaccard.tile_pairs(spark.createDataFrame(given, "key long, id long, n int, at int, label long, main long"), 80)
    assert {tuple(r) for r in out.collect()} == {(1, 2, 90, 90), (5, 6, 100, 80)}
