"""Running accumulators over live outputs.

Built-in aggregates where they suffice; otherwise a stateful processor whose state
has a fixed size per key: one tile of cells, one run or one gauge.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridspark import schema
from gridspark.functions.keys import to_int
from gridspark.operators.logs import FAILURES
from gridspark.streaming.run import use_state_store

TILE = 64

# Processors travel with the job, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_cell_maxima(frames: DataFrame, value: str = "h", dry: float = schema.WET_DEPTH) -> DataFrame:
    """Per cell: maximum, its earliest time, first arrival. Update mode, built-in aggregation."""
    given = F.col(value).isNotNull() & ~F.isnan(value)
    best = F.min(F.when(given, F.struct((-F.col(value)).alias("v"), F.col("t").alias("t"))))
    return (
        frames.groupBy("run", "i", "j")
        .agg(best.alias("_b"), F.min(F.when(F.col("h") > dry, F.col("t"))).alias("arrival"))
        .select("run", "i", "j", (-F.col("_b.v")).alias("peak"), F.col("_b.t").alias("time"), "arrival")
    )


class _LevelMaxima(StatefulProcessor):
    """State of one tile: level, maximum, its time and arrival per cell."""

    def __init__(self, dry: float):
        self.dry = dry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tile", "level array<int>, peak array<double>, time array<double>, arrival array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run, ti, tj = key
        if self.state.exists():
            level, peak, time, arrival = (np.array(a, dtype=float) for a in self.state.get())
        else:
            level, peak, time, arrival = (np.full(TILE * TILE, v) for v in (-1.0, np.nan, np.nan, np.nan))
        batch = pd.concat(rows).sort_values("t", kind="stable")
        touched = np.zeros(TILE * TILE, dtype=bool)
        for t, at in batch.groupby("t", sort=True):
            # Coarse to fine within one time, so a finer value of the same instant wins.
            for lev, part in at.groupby("level", sort=True):
                k = (part["j"].to_numpy() % TILE) * TILE + part["i"].to_numpy() % TILE
                v, h = part["value"].to_numpy(dtype=float), part["h"].to_numpy(dtype=float)
                use = (lev >= level[k]) & ~np.isnan(v)
                up = use & ((lev > level[k]) | ~(v <= peak[k]))
                peak[k[up]], time[k[up]] = v[up], t
                level[k[use]] = lev
                first = (h > self.dry) & np.isnan(arrival[k])
                arrival[k[first]] = t
                touched[k] = True
        self.state.update((level.astype(int).tolist(), peak.tolist(), time.tolist(), arrival.tolist()))
        k = np.flatnonzero(touched)
        none = lambda a: pd.Series(a[k]).astype(object).where(~np.isnan(a[k]), None)
        yield pd.DataFrame({
            "run": run, "i": (ti * TILE + k % TILE).astype("int32"), "j": (tj * TILE + k // TILE).astype("int32"), "level": level[k].astype("int32"),
            "peak": peak[k], "time": time[k], "arrival": none(arrival),
        })

    def close(self) -> None:
        pass


def stream_level_maxima(frames: DataFrame, value: str = "h", dry: float = schema.WET_DEPTH) -> DataFrame:
    """As `stream_cell_maxima` for frames with `level`: a finer level starts a cell's maximum afresh, a coarser one is ignored.

    The order of arrival matters for these resets; a batch is taken in time order.
    """
    rows = use_state_store(frames).select(
        "run", to_int(F.col("i") / TILE).alias("ti"), to_int(F.col("j") / TILE).alias("tj"), "i", "j", "t", "level", "h", F.col(value).alias("value")
    )
    return rows.groupBy("run", "ti", "tj").transformWithStateInPandas(
        _LevelMaxima(dry), "run string, i int, j int, level int, peak double, time double, arrival double", "Update", "None"
    )


class _MassFraction(StatefulProcessor):
    """State of one run: sums of its open frames and the first frame's volume; a timer for each open frame."""

    def __init__(self, stop: float):
        self.stop = stop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "frame int, volume double")
        self.open = handle.getMapState("open", "frame int", "ms long, t double, volume double, moving double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = False
        for part in rows:
            done = done or bool(part["done"].any())
            part = part[~part["done"]].astype({"frame": "int64"})
            for frame, ms, t, volume, moving in part.groupby("frame").agg({"ms": "max", "t": "min", "volume": "sum", "moving": "sum"}).itertuples():
                frame = int(frame)
                if self.open.containsKey((frame,)):
                    was, at, v, m = self.open.getValue((frame,))
                    self.handle.deleteTimer(was)
                    ms, t, volume, moving = max(ms, was), min(t, at), volume + v, moving + m
                self.open.updateValue((frame,), (int(ms), float(t), float(volume), float(moving)))
                self.handle.registerTimer(int(ms))
        if done:
            yield self.finish(key, None)
            self.first.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.finish(key, expiredTimerInfo.getExpiryTimeInMs())

    def finish(self, key, until: int | None) -> pd.DataFrame:
        """Open frames up to an instant, in order; all of them at the end of a run."""
        due = sorted((frame, sums) for (frame,), sums in self.open.iterator() if until is None or sums[0] <= until)
        out, first = [], self.first.get() if self.first.exists() else None
        for frame, (ms, t, volume, moving) in due:
            if first is None or frame < first[0]:
                first = (int(frame), float(volume))
            fraction = moving / first[1] if first[1] > 0 else 0.0
            out.append((key[0], frame, t, volume, moving, fraction, frame > 0 and fraction < self.stop))
            self.open.removeKey((frame,))
            if until is None:
                self.handle.deleteTimer(ms)
        if due:
            self.first.update(first)
        out = pd.DataFrame(out, columns=["run", "frame", "t", "volume", "moving", "fraction", "stop"])
        return out.astype({"frame": "int32", "t": float, "volume": float, "moving": float, "fraction": float, "stop": bool})

    def close(self) -> None:
        pass


def stream_mass_monitor(frames: DataFrame, moving: float, stop: float, area: float = 1.0, vel: float = schema.VELOCITY_DEPTH) -> DataFrame:
    """Wet and moving volume of each finished frame with the moving share of the first, and a stop signal.

    Needs the `ts` of `with_event_time`. A frame is finished once the watermark passes it, or when a row with `done` true tells
    that its run has ended (`closing_rows`); that ends this run alone, and later rows of its name are a new run. Cells are
    summed inside tasks before anything is grouped by run.
    """
    done = F.coalesce(F.col("done"), F.lit(False)) if "done" in frames.columns else F.lit(False)
    fast = (F.col("h") >= vel) & (F.col("speed") > moving)
    rows = use_state_store(frames).select(
        "run", "frame", "ts", "t", done.alias("done"), (F.col("h") * area).alias("volume"), F.when(fast, F.col("h") * area).otherwise(F.lit(0.0)).alias("moving"),
    )
    # The event time stays marked as such across the partial sums.
    fields = [rows.schema[c] for c in ("run", "frame", "ts", "t", "done", "volume", "moving")] + [T.StructField("ms", T.LongType())]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = batch.groupby(["run", "frame", "ts", "done"], dropna=False, as_index=False).agg({"t": "min", "volume": "sum", "moving": "sum"})
            sums["ms"] = sums["ts"].astype("datetime64[ms]").astype("int64")
            yield sums[[f.name for f in fields]]

    return rows.mapInPandas(partial, T.StructType(fields)).groupBy("run").transformWithStateInPandas(
        _MassFraction(stop), "run string, frame int, t double, volume double, moving double, fraction double, stop boolean", "Append", "EventTime"
    )


class _Decimate(StatefulProcessor):
    """State of one gauge: the last time let through."""

    def __init__(self, step: float):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values("t", kind="stable")
        last = self.last.get()[0] if self.last.exists() else -np.inf
        t, keep = batch["t"].to_numpy(), []
        # Jump from one kept sample to the next one far enough away.
        at = int(np.searchsorted(t, last + self.step)) if np.isfinite(last) else 0
        while at < len(t):
            keep.append(at)
            last = t[at]
            at = max(at + 1, int(np.searchsorted(t, last + self.step)))
        if keep:
            self.last.update((float(last),))
        yield batch.iloc[keep]

    def close(self) -> None:
        pass


def stream_gauge_decimate(series: DataFrame, step: float) -> DataFrame:
    """Samples of each gauge at least `step` after the last one let through."""
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.schema.fields)
    return use_state_store(series).groupBy("gauge").transformWithStateInPandas(_Decimate(step), cols, "Append", "None")


def _real(df: DataFrame) -> Column:
    """True for rows that carry a sample, not an end of the series."""
    return ~F.coalesce(F.col("done"), F.lit(False)) if "done" in df.columns else F.lit(True)


def gauge_windows(series: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding statistics per gauge; needs `ts` with its watermark. Rows of `closing_rows` close the last windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = series.groupBy("gauge", w.alias("w")).agg(F.count_if(_real(series)).alias("n"), F.min("q1").alias("low"), F.max("q1").alias("high"), F.avg("q1").alias("mean"))
    return out.where("n > 0").select("gauge", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "low", "high", "mean")


def gauge_sessions(series: DataFrame, gap: str) -> DataFrame:
    """Stretches of activity per gauge separated by more than `gap`; needs `ts` with its watermark. Rows of `closing_rows`
    close the last stretches."""
    out = series.groupBy("gauge", F.session_window("ts", gap).alias("w")).agg(F.count_if(_real(series)).alias("n"), F.max("q1").alias("high"))
    return out.where("n > 0").select("gauge", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "high")


class _LogAlerts:
    """State of one log: the end of the text seen so far and a bit for each failure already told."""

    #: Of the text seen, as much as can be the beginning of a failure text.
    KEEP = max(map(len, FAILURES)) - 1

    @staticmethod
    def take(key, rows, state: GroupState) -> Iterator[pd.DataFrame]:
        text, told = state.get if state.exists else ("", 0)
        parts = [(part["seq"].to_numpy(), part["text"].to_numpy()) for part in rows]
        seq, texts = parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts)]
        out = []
        for k in np.argsort(seq, kind="stable"):
            text += texts[k]
            for n, mark in enumerate(FAILURES):
                if not told >> n & 1 and mark in text:
                    told |= 1 << n
                    out.append((key[0], int(seq[k]), mark))
            text = text[-_LogAlerts.KEEP:]
        state.update((text, told))
        if out:
            yield pd.DataFrame(out, columns=["run", "seq", "reason"])


def stream_log_alerts(log: DataFrame) -> DataFrame:
    """First occurrence of each failure text in growing logs (run, seq, text), also when cut between two reads.

    There may be many logs of few lines each: state and rows of many of them travel together, not by a call for each."""
    return use_state_store(log).select("run", "seq", "text").groupBy("run").applyInPandasWithState(
        _LogAlerts.take, "run string, seq long, reason string", "tail string, told int", "append", GroupStateTimeout.NoTimeout
    )


class _Progress(StatefulProcessor):
    """State of one run: a bit per expected frame, how many are set, and whether its end was told."""

    def __init__(self, patience: float | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "bits binary, written long, expected long, told boolean, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bits, written, expected, told, due = self.state.get() if self.state.exists() else (b"", 0, 0, False, None)
        bits, done, more = np.frombuffer(bits, np.uint8).copy(), False, False
        for part in rows:
            done = done or bool(part["done"].any())
            expected = max(int(expected), int(part["expected"].max()))
            frame = part.loc[~part["done"], "frame"].dropna().astype("int64").unique()
            # A frame beyond the expected ones is none of them.
            frame = frame[(frame >= 0) & (frame < expected)]
            if len(bits) < (expected + 7) // 8:
                bits = np.pad(bits, (0, (expected + 7) // 8 - len(bits)))
            more = more or len(frame) > 0
            np.bitwise_or.at(bits, frame // 8, np.left_shift(1, frame % 8).astype(np.uint8))
        written = int(np.unpackbits(bits).sum())
        if due is not None:
            self.handle.deleteTimer(due)
        due = None
        if self.patience is not None and not done and written < expected:
            due = int(timerValues.getCurrentProcessingTimeInMs() + self.patience * 1000)
            self.handle.registerTimer(due)
        self.state.update((bits.tobytes(), written, int(expected), done, due))
        yield self.report(key, written, expected, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bits, written, expected, told, due = self.state.get()
        if not told:
            self.state.update((bytes(bits), written, expected, True, None))
            yield self.report(key, written, expected, True)

    def report(self, key, written: int, expected: int, ended: bool) -> pd.DataFrame:
        status = "complete" if written >= expected else "incomplete" if ended else "running"
        return pd.DataFrame([(key[0], expected, written, status)], columns=["run", "expected", "written", "status"])

    def close(self) -> None:
        pass


def stream_progress(frames: DataFrame, runs: DataFrame, patience: float | None = None) -> DataFrame:
    """(run, expected, written, status) after each arrival, from a stream of (run, frame[, done]) and `runs(run, expected)`.

    Frames are numbered from 0 and repeats count once. A run is `running`, `complete` once all expected frames are there, and
    `incomplete` if a row with `done` true ends it before, or if nothing came of it for `patience` seconds of
    the clock; a frame that comes later opens it again. The state is a bit per expected frame. Update mode.
    """
    done = F.coalesce(F.col("done"), F.lit(False)) if "done" in frames.columns else F.lit(False)
    rows = use_state_store(frames).join(runs.select("run", F.col("expected").cast("long").alias("expected")), "run").select("run", "expected", "frame", done.alias("done"))
    return rows.groupBy("run").transformWithStateInPandas(
        _Progress(patience), "run string, expected long, written long, status string", "Update", "None" if patience is None else "ProcessingTime"
    )


class _Rest(StatefulProcessor):
    """State of one run: samples in a row below the threshold and the time of the first."""

    def __init__(self, fraction: float, samples: int):
        self.fraction, self.samples = fraction, samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rest", "below int, since double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        below, since = self.state.get() if self.state.exists() else (0, None)
        part = pd.concat(rows).sort_values("t", kind="stable")
        t, low = part["t"].to_numpy(float), part["moving_fraction"].to_numpy(float) <= self.fraction
        at = np.arange(len(t))
        # The last sample above the threshold so far, or -1 for a stretch that began before this batch.
        high = np.maximum.accumulate(np.where(low, -1, at))
        run = np.where(low, at - high + np.where(high < 0, below, 0), 0)
        start = np.where((high < 0) & (below > 0), np.nan if since is None else since, t[np.minimum(high + 1, len(t) - 1)])
        self.state.update((int(run[-1]), float(start[-1]) if run[-1] else None))
        rest = pd.Series(np.where(run >= self.samples, start, np.nan)).astype(object).where(run >= self.samples, None)
        yield pd.DataFrame({"run": key[0], "t": t, "below": run.astype("int32"), "rest": rest.to_numpy()})

    def close(self) -> None:
        pass


def stream_rest(history: DataFrame, fraction: float = 0.01, samples: int = 3) -> DataFrame:
    """Samples below the threshold in a row and the provisional rest time; a rebound starts over."""
    run = dict(history.dtypes)["run"]
    return use_state_store(history).select("run", "t", "moving_fraction").groupBy("run").transformWithStateInPandas(
        _Rest(fraction, samples), f"run {run}, t double, below int, rest double", "Append", "None"
    )
