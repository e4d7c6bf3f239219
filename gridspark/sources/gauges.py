"""Binary gauge series: records of level, time and the variables, one after the other."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.sources.frames import WIDTH, sized
from gridspark.sources.ranges import CHUNK, listed, numbers, pieces, read_ranges

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def binary_series(spark: SparkSession, path: str, glob: str, heads: DataFrame) -> DataFrame:
    """(run, gauge, x, y, kind, level, t, q) of the gauges whose header (run, file, gauge, ...) names a binary form.

    A payload of a size that is no number of whole records is an error; a header without payload has no rows."""
    name = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")
    files = listed(spark, path, glob.rsplit(".", 1)[0] + ".bin").withColumn("_name", name("file"))
    plan = heads.where("format <> 'ascii'").withColumn("_name", name("file")).drop("file").join(files, ["run", "_name"])
    record = f"(num_eqn + 2L) * {WIDTH}"
    plan = plan.where(sized(f"bytes - bytes % ({record})")).withColumn("records", F.expr(f"bytes div ({record})"))

    def decode(row: dict, data: bytes) -> pa.RecordBatch:
        v = numbers(row, data).reshape(row["count"], row["num_eqn"] + 2)
        n = len(v)
        text = lambda c: pa.array([row[c]] * n, pa.string())
        same = lambda c, kind: pa.array([row[c]] * n, kind)
        return pa.RecordBatch.from_pydict({
            "run": text("run"), "gauge": same("gauge", pa.int64()), "x": same("x", pa.float64()), "y": same("y", pa.float64()), "kind": text("kind"),
            "level": pa.array(v[:, 0].astype("int32")), "t": pa.array(v[:, 1].copy()),
            "q": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * row["num_eqn"], pa.int32()), pa.array(v[:, 2:].ravel())),
        })

    return read_ranges(pieces(plan, "records", record, "0", str(CHUNK)), decode, "run string, gauge long, x double, y double, kind string, level int, t double, q array<double>")
