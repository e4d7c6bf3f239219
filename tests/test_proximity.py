"""Track points near stations: places that repeat."""

from plan_rows import joined_rows
from pyspark.sql import functions as F

from gridspark.operators import joins as J


def test_equal_places_are_compared_once(spark):
    """1,000 points at one place, 200 stations 100 km away from it in the same squares: one comparison, no row."""
    tracks = spark.range(1000).select(F.col("id").alias("storm"), F.lit(-80.25).alias("lon"), F.lit(20.25).alias("lat"))
    stations = spark.range(200).select(F.col("id").alias("station"), F.lit(-80.75).alias("lon"), F.lit(20.75).alias("lat"))
    out = J.storm_proximity(tracks, stations, 60.0)
    assert out.collect() == []
    assert joined_rows(out._jdf.queryExecution().executedPlan()) < 100


def test_all_points_and_stations_of_a_place_are_told(spark):
    tracks = spark.createDataFrame([(1, 0, -80.0, 20.0), (2, 0, -80.0, 20.0), (2, 1, -80.0, 20.0), (3, 0, 10.0, 20.0), (4, 0, None, 20.0)], "storm long, row_no long, lon double, lat double")
    stations = spark.createDataFrame([(k, -80.0, 20.5) for k in range(1500)] + [(None, -80.0, 20.5), (9000, -80.0, 22.0)], "station long, lon double, lat double")
    out = J.storm_proximity(tracks, stations, 60.0, digits=3)
    rows = {(r.storm, r.row_no, r.station) for r in out.collect()}
    assert out.columns == ["storm", "row_no", "lon", "lat", "station", "distance_km", "bearing"]
    assert rows == {(s, n, k) for s, n in ((1, 0), (2, 0), (2, 1)) for k in [*range(1500), None]} and out.count() == 4503
    assert {(r.distance_km, r.bearing) for r in out.collect()} == {(55.567, 180.0)}
