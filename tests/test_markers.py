"""Marker files lie in their folders at once, without a committer's traces."""

from gridspark.plans.sources import put_markers
from gridspark.sources import text


def test_markers(spark, tmp_path):
    raw = spark.createDataFrame([(str(k), '{"status": "completed", "crs": "x", "rho": %d.0}' % k if k % 3 else "{broken") for k in range(30)], "run string, text string")
    path = put_markers(raw, str(tmp_path / "runs"))
    assert sorted(p.relative_to(path).as_posix() for p in (tmp_path / "runs").rglob("*") if p.is_file()) == sorted(f"run={k}/run.txt" for k in range(30))
    assert sorted((r.run, r.rho) for r in text.scan_runs(spark, path, "*.txt").collect()) == sorted((str(k), float(k)) for k in range(30) if k % 3)
