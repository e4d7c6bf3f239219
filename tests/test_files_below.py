"""Files below a folder are listed and read by tasks, as Spark's own readers would name them."""

from pyspark.sql import functions as F

from gridspark.sources import text
from gridspark.sources.ranges import files_below, listed

NAMES = ["run=1/run.txt", "run=2/run.txt", "deep/a/b/run.txt", "own name/ü+ö é%20#.txt", "run=3/other.csv", "_hidden/run.txt", "_a=9/run.txt", ".dot/run.txt", "run=4/_run.txt", "run=5/.x.txt", "top.txt", "run=6/empty.txt"]


def made(tmp_path):
    for k, name in enumerate(NAMES):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("" if "empty" in name else '{"status": "completed", "rho": %d.5}\n' % k)
    (tmp_path / "run=7").mkdir()
    return str(tmp_path)


def test_same_files_as_sparks_reader(spark, tmp_path):
    path = made(tmp_path)
    for at in (path, path + "/", "file:" + path, "file://" + path):
        theirs = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(at)
        want = sorted(map(tuple, theirs.select(F.col("_metadata.file_path"), "length").collect()))
        got = sorted(map(tuple, files_below(spark, at, "*.txt").select("file", "length").collect()))
        assert got == want and len(got) == 6


def test_patterns_only_hadoop_knows(spark, tmp_path):
    path = made(tmp_path)
    assert files_below(spark, path + "/run=[12]", "*.txt", content=True).count() == 2
    assert listed(spark, path, "{run,top}.txt").count() == 5


def test_runs_are_not_listed_by_the_driver(spark, tmp_path):
    out = text.scan_runs(spark, made(tmp_path), "*.txt")
    assert sorted((r["run"], r["rho"]) for r in out.where("run in ('1', '2', 'b')").collect()) == [("1", 0.5), ("2", 1.5), ("b", 2.5)]
    assert out.count() == 6
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()
