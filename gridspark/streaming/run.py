"""Running streams: state store, replayable sinks, late data."""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(df: DataFrame) -> DataFrame:
    """Stateful processors need the RocksDB store."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return df


def read_cells(spark, path: str, schema: str | StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A growing Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_event_time(df: DataFrame, delay: str, origin: str | Column = "2000-01-01T00:00:00Z", dedupe: list[str] | None = None) -> DataFrame:
    """Add `ts` = origin + t with a watermark of `delay`; repeats of `dedupe` keys within it are dropped.

    The origin must lie after 1970: a stream starts with its watermark there and a
    row at the very start of that year would already be late. Rows behind the watermark are left out of later stateful steps; `counting_late_rows`
    tells how many.
    """
    base = F.to_timestamp(F.lit(origin)) if isinstance(origin, str) else origin
    ts = F.timestamp_millis(F.unix_millis(base) + F.round(F.col("t") * 1000).cast("long"))
    out = df.withColumn("ts", ts).withWatermark("ts", delay)
    return out.dropDuplicatesWithinWatermark(dedupe) if dedupe else out


def closing_rows(ends: DataFrame, like: DataFrame, hold: float) -> DataFrame:
    """Rows that tell a stream of the columns of `like` that its sources have ended: `ends` has their keys and last `t`.

    A closing row has `done` true, NULL in all other columns and a time `hold` seconds past the end, so that it also moves the
    watermark on: `hold` is the longest window plus the delay. The watermark is one for the whole stream, so windows
    of other sources up to that time close with it; per-run monitors end a run by its own `done` row alone."""
    given = ends.withColumns({"t": F.col("t") + F.lit(float(hold)), "done": F.lit(True)})
    return given.select(*[(F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


class LateRows(StreamingQueryListener):
    """Rows dropped behind the watermark, of every batch of every query of a session that it listens to.

    Reports come from Spark batch by batch, so none is lost however long a query runs. They are written to `path` as a table
    (query, batch, operator, late) each time `every` of them have come, and when a query ends."""

    def __init__(self, spark, path: str, every: int = 1000):
        self.spark, self.path, self.every = spark, path, every
        self.rows, self.lock, self.ended = [], threading.Lock(), {}

    def onQueryStarted(self, event) -> None:
        self.ended[str(event.runId)] = threading.Event()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            self.rows += [(str(p.id), p.batchId, n, op.numRowsDroppedByWatermark) for n, op in enumerate(p.stateOperators) if op.numRowsDroppedByWatermark]
            full = len(self.rows) >= self.every
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, LATE).coalesce(1).write.mode("append").parquet(self.path)

    def wait(self, query, seconds: float = 60.0) -> None:
        """Until all reports of a finished query are written."""
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError("the end of the query was not reported")
        self.flush()


LATE = "query string, batch long, operator int, late long"


@contextmanager
def counting_late_rows(spark, path: str):
    """Listen for late rows while the body runs its queries; `wait` of the listener is due before it is removed."""
    listener = LateRows(spark, path)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def late_rows(spark, path: str) -> DataFrame:
    """(query, batch, late): rows dropped as late per batch; a repeated report of a batch counts once."""
    try:
        rows = spark.read.schema(LATE).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], LATE)
    return rows.groupBy("query", "batch", "operator").agg(F.max("late").alias("late")).groupBy("query", "batch").agg(F.sum("late").alias("late"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", late: LateRows | None = None, partitions: int | None = None):
    """Process what is there into `path`/batch=N folders; `late` gets the counts of late rows.

    A repeated batch replaces its own folder, so results survive restarts unchanged. Every batch commits each state
    partition: a stream of many small arrivals wants few `partitions`, which it keeps from its first start on.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf, key = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(key)
    if partitions:
        conf.set(key, str(partitions))
    try:
        # A stream runs in a copy of the session as it is at its start.
        query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
    query.awaitTermination()
    if late:
        late.wait(query)
    return query


def latest(spark, path: str, keys: list[str]) -> DataFrame:
    """The last result of each key over all batches written in update mode."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("_r")).select(*keys, "_r.*")
