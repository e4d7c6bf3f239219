"""Streams that end: one run closed alone, silent runs, frames beyond the expected ones, text cut between reads."""

import tempfile
import time

from gridspark.operators.logs import FAILURES
from gridspark.streaming import monitors
from gridspark.streaming.run import read_cells, run_available, with_event_time

CELLS = "run string, frame int, t double, i int, j int, h double, speed double, done boolean"


class Replay:
    def __init__(self, spark, schema, build, mode="append"):
        self.spark, self.schema, self.build, self.mode = spark, schema, build, mode
        self.base = tempfile.mkdtemp(prefix="stream-")

    def give(self, rows):
        self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(f"{self.base}/in")
        run_available(self.build(read_cells(self.spark, f"{self.base}/in", self.schema)), f"{self.base}/out", f"{self.base}/state", self.mode)
        return self.spark.read.parquet(f"{self.base}/out")


def test_a_run_ends_alone(spark):
    cells = lambda run, frame, h, speed: [(run, frame, frame * 10.0, i, 0, h, speed, False) for i in range(3)]
    end = lambda run, t: (run, None, t, None, None, None, None, True)
    build = lambda s: monitors.stream_mass_monitor(with_event_time(s, "1 second", dedupe=["run", "frame", "i", "j"]), 0.5, 0.5)
    replay = Replay(spark, CELLS, build)
    out = replay.give(cells("a", 0, 2.0, 1.0) + cells("b", 0, 4.0, 1.0) + cells("a", 1, 2.0, 0.1)[:2])
    out = replay.give(cells("a", 1, 2.0, 0.1) + [end("a", 10.0)])
    got = {(r.run, r.frame): (r.volume, r.moving, r.fraction, r.stop) for r in out.collect()}
    # The cells of frame 1 that came twice count once; b's frame 1 has not come, and its frame 0 is behind the watermark.
    assert got[("a", 0)] == (6.0, 6.0, 1.0, False) and got[("a", 1)] == (6.0, 0.0, 0.0, True)
    assert ("b", 1) not in got


def test_silent_runs_are_incomplete(spark):
    runs = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2)], "run string, expected int")
    base, kind = tempfile.mkdtemp(prefix="stream-"), "run string, frame int, t double"
    give = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{base}/in")
    spark.createDataFrame([], "run string, expected long, written long, status string").write.parquet(f"{base}/out/batch=-1")
    give([("a", 0, 0.0), ("a", 0, 0.0), ("b", 0, 0.0), ("b", 1, 1.0), ("b", 7, 1.0)])
    save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    stream = monitors.stream_progress(read_cells(spark, f"{base}/in", kind), runs, patience=1.0)
    query = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(processingTime="1 second").start()

    def wait_for(run, status):
        for _ in range(60):
            time.sleep(1)
            out = {(r.run, r.status): r.written for r in spark.read.schema("run string, expected long, written long, status string, batch int").parquet(f"{base}/out").collect()}
            if (run, status) in out:
                return out
        raise AssertionError(f"{run} was never {status}")

    try:
        out = wait_for("a", "incomplete")
        assert out[("a", "incomplete")] == 1 and out[("b", "complete")] == 2
        give([("a", 1, 1.0), ("a", 2, 2.0)])
        assert wait_for("a", "complete")[("a", "complete")] == 3
    finally:
        query.stop()


def test_alert_tail_is_the_longest_mark():
    assert monitors._LogAlerts.KEEP == max(map(len, FAILURES)) - 1
