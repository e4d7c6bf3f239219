"""Scans of solver frames: fixed grids and nested patches, as text or as binary payloads."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions import running
from gridspark.operators.joins import complete_frames
from gridspark.sources.ranges import CHUNK, listed, numbers, pieces, read_ranges
from gridspark.sources.text import lines, number, numbered_lines, tokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a value by format.
WIDTH = "case format when 'binary32' then 4 else 8 end"


def frame_of(file: str = "file") -> Column:
    """Frame number at the end of a file's name."""
    return F.regexp_extract(file, r"\.[a-z](\d+)$", 1).try_cast("int")


def frame_times(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """(run, frame, t, meqn, ghosts, format) from the time files."""
    t = lines(spark, path, f"{stem}.t*").withColumns({"frame": frame_of(), "_t": tokens()})
    key = lambda name: F.contains("text", F.lit(name))
    times = t.groupBy("run", "frame").agg(
        F.max(F.when(key("time"), number(F.col("_t")[0]))).alias("t"),
        F.max(F.when(key("num_eqn") | key("meqn"), F.col("_t")[0].try_cast("int"))).alias("meqn"),
        F.coalesce(F.max(F.when(key("ghost"), F.col("_t")[0].try_cast("int"))), F.lit(0)).alias("ghosts"),
        F.coalesce(F.max(F.when(key("format"), F.lower(F.col("_t")[0]))), F.lit("ascii")).alias("format"),
    )
    bad = F.raise_error(F.lit("a frame has no finite time")).cast("double")
    return times.withColumn("t", F.when(F.abs("t") < float("inf"), F.col("t")).otherwise(bad))


def frame_headers(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """(run, frame, t, meqn, ghosts, format) from the time files and (mx, my, xlow, ylow, dx, dy) from the headers."""
    h = lines(spark, path, f"{stem}.q*").withColumns({"frame": frame_of(), "_t": tokens()})
    names = ("mx", "my", "xlow", "ylow", "dx", "dy")
    heads = h.groupBy("run", "frame").agg(*[F.max(F.when(F.col("_t")[1] == n, number(F.col("_t")[0]))).alias(n) for n in names])
    return frame_times(spark, path, stem).join(heads, ["run", "frame"])


def scan_frames(spark: SparkSession, path: str, stem: str = "fgout0001", names: Sequence[str] = ("h", "hu", "hv", "b"), missing: str = "error") -> DataFrame:
    """Frames of a fixed grid to (run, frame, t, i, j, x, y, *names), each in the form its time file names.

    A binary payload is read in ranges by many tasks; a text frame has its values after its header, line by line.
    `missing` decides whether a binary frame's time file without payload is an error or skipped. A payload of another size
    than its header says is an error.
    """
    heads = frame_headers(spark, path, stem)
    files = listed(spark, path, f"{stem}.b*").withColumn("frame", frame_of())
    binary, _ = complete_frames(heads.where("format <> 'ascii'"), files.select("run", "frame"), missing)
    out = decode_frames(files, binary, names)
    times = heads.where("format = 'ascii'").select("run", "frame", "t")
    patches, cells = parse_patches(numbered_lines(spark, path, f"{stem}.q*").withColumn("frame", frame_of()), times)
    place = patches.select("run", "frame", "xlow", "ylow", "dx", "dy")
    text = cells.join(place, ["run", "frame"]).select(
        "run", "frame", "t", "i", "j", (F.col("xlow") + (F.col("i") + 0.5) * F.col("dx")).alias("x"), (F.col("ylow") + (F.col("j") + 0.5) * F.col("dy")).alias("y"),
        *[F.col("q")[k].alias(n) for k, n in enumerate(names)],
    )
    return out.unionByName(text)


def sized(expected: str) -> Column:
    """True, or an error for a file of another number of bytes than `expected`."""
    wrong = F.raise_error(F.concat(F.lit("size differs from the header: "), F.col("file"))).cast("boolean")
    return F.when(F.expr(f"bytes = {expected}"), F.lit(True)).otherwise(wrong)


def decode_frames(files: DataFrame, heads: DataFrame, names: Sequence[str] = ("h", "hu", "hv", "b")) -> DataFrame:
    """Payload files (run, frame, file, bytes) with their headers to cells; values run over variables, then i, then j."""
    cols = list(names)
    plan = files.join(heads.drop("ghosts"), ["run", "frame"]).where(sized(f"cast(mx * my * meqn as bigint) * {WIDTH}"))

    def decode(row: dict, data: bytes) -> pa.RecordBatch:
        q = numbers(row, data).reshape(-1, row["meqn"])
        k = np.arange(row["first"], row["first"] + row["count"])
        i, j, n = k % int(row["mx"]), k // int(row["mx"]), len(k)
        out = {
            "run": pa.array([row["run"]] * n, pa.string()), "frame": pa.array(np.full(n, row["frame"], "int32")), "t": pa.array(np.full(n, row["t"])),
            "i": pa.array(i.astype("int32")), "j": pa.array(j.astype("int32")),
            "x": pa.array(row["xlow"] + (i + 0.5) * row["dx"]), "y": pa.array(row["ylow"] + (j + 0.5) * row["dy"]),
        } | {c: pa.array(q[:, m]) for m, c in enumerate(cols)}
        return pa.RecordBatch.from_pydict(out)

    schema = "run string, frame int, t double, i int, j int, x double, y double, " + ", ".join(f"{n} double" for n in cols)
    return read_ranges(pieces(plan, "mx * my", f"cast(meqn as bigint) * {WIDTH}", "0", str(CHUNK)), decode, schema)


# Header words of a patch, in order (fixed values).
PATCH_WORDS = ("grid_number", "AMR_level", "mx", "my", "xlow", "ylow", "dx", "dy")


def scan_patches(spark: SparkSession, path: str, stem: str = "fort") -> tuple[DataFrame, DataFrame]:
    """Frames of nested patches to (patches, patch_cells), text and binary alike: header lines open a patch; in a text frame one
    line per cell follows, in a binary one the payload file holds the patches one after the other with their ghost cells.

    Lines are numbered and counted along each file and payloads are read in ranges, so a frame of many patches is
    parsed by many tasks. Ghost cells are left out.
    """
    times = frame_times(spark, path, stem)
    opened, heads = open_patches(numbered_lines(spark, path, f"{stem}.q*").withColumn("frame", frame_of()), times)
    files = listed(spark, path, f"{stem}.b*").withColumn("frame", frame_of())
    return patch_table(heads), text_cells(opened, heads).unionByName(decode_patches(files, heads.drop("t", "file").join(times.where("format <> 'ascii'"), ["run", "frame"])))


def parse_patches(ln: DataFrame, times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run, file, frame, line_no, text) lines and (run, frame, t) to (patches, patch_cells)."""
    opened, heads = open_patches(ln, times)
    return patch_table(heads), text_cells(opened, heads)


def open_patches(ln: DataFrame, times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with the number of their patch in the file, and a row per patch."""
    ln = ln.where(F.trim("text") != "").withColumn("_t", tokens())
    word = F.try_element_at("_t", F.lit(2))
    ln = ln.withColumn("_w", F.when(word.isin(*PATCH_WORDS), word))
    ln = ln.withColumns({"_open": (F.coalesce(F.col("_w") == "grid_number", F.lit(False))).cast("int"), "_cell": F.col("_w").isNull().cast("int")})
    ln = running(ln, ["run", "file"], "line_no", {"_patch": ("sum", "_open"), "_n": ("sum", "_cell")})
    h = ln.where("_cell = 0").groupBy(*PATCH_KEYS).agg(
        F.min("_n").alias("_base"), *[F.max(F.when(F.col("_w") == w, number(F.col("_t")[0]))).alias(f"_{w}") for w in PATCH_WORDS]
    )
    return ln, h.join(times.select("run", "frame", "t"), ["run", "frame"]).select(
        *PATCH_KEYS, "_base", "t", F.col("_grid_number").cast("int").alias("patch"), F.col("_AMR_level").cast("int").alias("level"),
        *[F.col(f"_{w}").alias(w) for w in ("xlow", "ylow", "dx", "dy")], F.col("_mx").cast("int").alias("mx"), F.col("_my").cast("int").alias("my"),
    )


PATCH_KEYS = ["run", "frame", "file", "_patch"]


def patch_table(heads: DataFrame) -> DataFrame:
    return heads.drop("file", "_patch", "_base")


def text_cells(ln: DataFrame, heads: DataFrame) -> DataFrame:
    k = F.col("_n") - F.col("_base") - 1
    return ln.where("_cell = 1").join(heads, PATCH_KEYS).select(
        "run", "frame", "t", "patch", "level", (k % F.col("mx")).cast("int").alias("i"), F.floor(k / F.col("mx")).cast("int").alias("j"),
        F.transform("_t", number).alias("q"),
    )


def decode_patches(files: DataFrame, heads: DataFrame) -> DataFrame:
    """Payload files (run, frame, file, bytes) and their patches with meqn, ghosts and format to cells without ghosts."""
    size = F.expr(f"(mx + 2L * ghosts) * (my + 2L * ghosts) * meqn * {WIDTH}")
    order = Window.partitionBy("run", "frame").orderBy("_patch")  # the patches of one frame
    placed = heads.withColumn("_size", size).withColumns({
        "_offset": F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size"),
        "_all": F.sum("_size").over(Window.partitionBy("run", "frame")),
    })
    row = f"(mx + 2L * ghosts) * meqn * {WIDTH}"
    plan = files.join(placed, ["run", "frame"]).where(sized("_all")).drop("_base", "_patch", "_size", "_all")
    plan = pieces(plan, "my", row, f"_offset + ghosts * {row}", f"greatest(1, {CHUNK} div (mx + 2 * ghosts))")

    def decode(row: dict, data: bytes) -> pa.RecordBatch:
        ghosts, mx, rows = row["ghosts"], row["mx"], row["count"]
        q = numbers(row, data).reshape(rows, mx + 2 * ghosts, row["meqn"])[:, ghosts:ghosts + mx].reshape(rows * mx, row["meqn"])
        k, n = np.arange(rows * mx), rows * mx
        same = lambda c, kind: pa.array(np.full(n, row[c], kind))
        return pa.RecordBatch.from_pydict({
            "run": pa.array([row["run"]] * n, pa.string()), "frame": same("frame", "int32"), "t": same("t", "float64"), "patch": same("patch", "int32"),
            "level": same("level", "int32"), "i": pa.array((k % mx).astype("int32")), "j": pa.array((row["first"] + k // mx).astype("int32")),
            "q": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * row["meqn"], pa.int32()), pa.array(q.ravel())),
        })

    return read_ranges(plan, decode, "run string, frame int, t double, patch int, level int, i int, j int, q array<double>")
