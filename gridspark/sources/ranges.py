"""Byte ranges of binary files as rows that are read where they lie, so one large payload is the work of many tasks.

A plan is an ordinary DataFrame with `file`, `start` and `length` in bytes and whatever decoding needs; no payload is
joined or shuffled, and none reaches one task or the driver as a whole. Files are opened by the worker through Arrow's file
systems, which know local and shared paths and the usual stores by their URI.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable, Iterator, Sequence
from fnmatch import fnmatchcase
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.sources.text import run_of

# Readers travel with the job, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells or records of a range, at most (a single row of cells may be longer).
CHUNK = 500_000


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:") or "://" not in uri:
        path = unquote(uri.removeprefix("file:")) if uri.startswith("file:") else uri
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, content: bytes) -> None:
    """Write a whole small file, with its folders."""
    system, path = located(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(content)


def escaped(value: str) -> str:
    """A value as part of a folder's name, as Spark's partition discovery reads it."""
    return re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)


def put_files(
    df: DataFrame, path: str, by: str, file: Column, order: Sequence[str], values: Sequence[str], encode: Callable[[pa.RecordBatch], bytes], header: str = ""
) -> None:
    """Write rows (by, ..., values) as one file `path`/by=value/`file` for each value and file name, rows in order.

    Each task writes its files in place, batch by batch: a committer would move them one by one at the end, and a call for
    each file would cost more than its rows. A task that is repeated writes its files anew."""
    system, root = located(path)
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(path)
        now, out = None, None
        try:
            for batch in batches:
                keys = list(zip(batch["_by"].to_pylist(), batch["_file"].to_pylist()))
                cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
                for at, to in zip([0, *cuts], [*cuts, len(keys)]):
                    if at == to:
                        continue
                    if keys[at] != now:
                        if out is not None:
                            out.close()
                        now = keys[at]
                        folder = f"{root}/{by}={escaped(now[0]) if now[0] else '__HIVE_DEFAULT_PARTITION__'}"
                        system.create_dir(folder, recursive=False)
                        out = system.open_output_stream(f"{folder}/{now[1]}")
                        out.write(header.encode())
                    out.write(encode(batch.slice(at, to - at)))
        finally:
            if out is not None:
                out.close()
        yield from ()

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns({"_by": F.col(by).cast("string"), "_file": file}).repartition(tasks, "_by", "_file")
    rows.sortWithinPartitions("_by", "_file", *order).select("_by", "_file", *values).mapInArrow(write, "_by string").count()


def put_text(df: DataFrame, path: str, by: str, file: Column, *order: str, header: str = "") -> None:
    """Write lines (by, ..., text) as text files, see `put_files`."""
    put_files(df, path, by, file, order, ["text"], lambda part: ("\n".join(part["text"].to_pylist()) + "\n").encode(), header)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark's readers would give it."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if path.startswith("file:") or ("://" not in path and default.startswith("file:")):
        return "file:" + encoded(os.path.abspath(re.sub("^file:/+", "/", path)))
    return path if "://" in path else default.rstrip("/") + "/" + path.lstrip("/")


def encoded(path: str) -> str:
    """A path as it stands in the URIs that Spark gives."""
    return re.sub("[\x00-\x7f]", lambda m: quote(m[0], safe="/!$&'()*+,;=:@~"), path)


def known(path: str, glob: str) -> bool:
    """Whether tasks can list a path by themselves: Arrow's file systems know it, and no pattern is in it that only Hadoop's clients read."""
    if re.search(r"[*?{\[\\]", path) or re.search(r"[{\\^]", glob):
        return False
    try:
        located(path)
    except Exception:  # noqa: BLE001 - whichever way a store says that it is unknown
        return False
    return True


def entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, whether it is a folder, bytes) of what lies in a folder, one by one where the system allows; hidden as Spark's readers do it."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            rows = ((e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size) for e in found)
            yield from (r for r in rows if shown(r[0]))
        return
    for info in system.get_file_info(fs.FileSelector(folder)):
        if shown(info.base_name):
            yield info.base_name, info.type == fs.FileType.Directory, info.size


def shown(name: str) -> bool:
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def below(system: fs.FileSystem, folder: str, uri: str) -> Iterator[tuple[str, str, int]]:
    """(path, URI, bytes) of all files below a folder."""
    for name, is_folder, size in entries(system, folder):
        at = (f"{folder}/{name}", f"{uri}/{encoded(name)}")
        if is_folder:
            yield from below(system, *at)
        else:
            yield (*at, size)


#: Files or names a batch holds, and bytes it holds, at most (fixed values); a single file may be longer.
BATCH, BATCH_BYTES = 4096, 4 << 20


def files_below(spark: SparkSession, path: str, glob: str, content: bool = False) -> DataFrame:
    """(file, length), with `content` also `value`, the whole text, of the matching files below `path` that are not empty.

    One task names what lies in `path` itself, all tasks look into the folders there: no list of files reaches the driver."""
    if not known(path, glob):
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        raw = reader.option("wholetext", True).text(path) if content else reader.format("binaryFile").load(path)
        length = F.col("_metadata.file_size").alias("length")
        return raw.select(F.col("_metadata.file_path").alias("file"), length, *(["value"] if content else []))

    path = qualified(spark, path)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(path)
        for batch in batches:
            names, folders = [], []
            for _ in range(batch.num_rows):
                for name, is_folder, _size in entries(system, root):
                    names.append(name), folders.append(is_folder)
                    if len(names) == BATCH:
                        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "folder": pa.array(folders, pa.bool_())})
                        names, folders = [], []
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "folder": pa.array(folders, pa.bool_())})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(path)

        def found() -> Iterator[tuple[str, str, int]]:
            for batch in batches:
                for row in batch.to_pylist():
                    at = (f"{root.rstrip('/')}/{row['name']}", f"{path.rstrip('/')}/{encoded(row['name'])}")
                    if row["folder"]:
                        yield from below(system, *at)
                    else:
                        yield (*at, system.get_file_info(at[0]).size)

        def made(rows: list) -> pa.RecordBatch:
            file, length, value = zip(*rows) if rows else ((), (), ())
            out = {"file": pa.array(file, pa.string()), "length": pa.array(length, pa.int64())}
            return pa.RecordBatch.from_pydict(out | ({"value": pa.array(value, pa.string())} if content else {}))

        rows, size = [], 0
        for at, uri, length in found():
            if not length or not fnmatchcase(at.rsplit("/", 1)[1], glob):
                continue
            value = None
            if content:
                with system.open_input_stream(at) as source:
                    value = source.read().decode(errors="replace")
                size += len(value)
            rows.append((uri, length, value))
            if len(rows) == BATCH or size >= BATCH_BYTES:
                yield made(rows)
                rows, size = [], 0
        yield made(rows)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = spark.range(0, 1, 1, 1).mapInArrow(top, "name string, folder boolean").repartition(tasks, "name")
    return names.mapInArrow(look, "file string, length long" + (", value string" if content else ""))


def listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(run, file, bytes) of the matching files below `path`; no content is read."""
    return files_below(spark, path, glob).select(run_of().alias("run"), "file", F.col("length").alias("bytes"))


def pieces(plan: DataFrame, rows: str, per_row: str, offset: str, at_once: str) -> DataFrame:
    """Cut each row of a plan into ranges of at most `at_once` of its `rows`, each `per_row` bytes, the first at byte `offset`:
    adds first (row number), count, start and length."""
    cut = plan.where(f"{rows} > 0").withColumn("first", F.explode(F.expr(f"sequence(0L, cast({rows} as bigint) - 1, cast({at_once} as bigint))")))
    cut = cut.withColumn("count", F.expr(f"least(cast({at_once} as bigint), cast({rows} as bigint) - first)"))
    return cut.withColumns({"start": F.expr(f"cast({offset} as bigint) + first * ({per_row})"), "length": F.expr(f"count * ({per_row})")})


def read_ranges(plan: DataFrame, decode: Callable[[dict, bytes], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Each range of the plan as the record batch that `decode` makes of its row and bytes.

    A range that ends before its length is an error. Plans are small rows, which would end up in few tasks if dealt by size: they are
    dealt by number."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = located(row["file"])
                with system.open_input_file(path) as source:
                    data = source.read_at(row["length"], row["start"])
                if len(data) != row["length"]:
                    raise ValueError(f"{path}: {len(data)} of {row['length']} bytes at {row['start']}")
                yield decode(row, data)

    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plan.repartition(tasks, "file", "start").mapInArrow(read, schema)


def numbers(row: dict, data: bytes) -> np.ndarray:
    """The values of a range as doubles, by the row's `format`."""
    return np.frombuffer(data, np.float32 if row["format"] == "binary32" else np.float64).astype(np.float64)
