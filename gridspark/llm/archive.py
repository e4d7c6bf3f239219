"""A content-addressed archive of WARC records: payload bytes once, exact record headers apart, records by joins.

An archive is a folder of two tables. `payloads` holds the bytes of each different payload once, under their SHA-256
(`digest`, `bytes`). `headers` holds a row per record: the exact bytes of its head, that is WARC fields, blank line and
HTTP fields, and the digest of its payload. The original records are head, payload and two line ends, joined by digest.

Only digests and heads meet in the choice of the first capture; payload bytes are shuffled once when the store is
written, combined by digest inside each task before that, and once more when records are put together. A payload that
a third of all records share is one row of the store; its heads are a skewed side of an ordinary join, which adaptive
execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import Kept

#: Smaller payloads are always stored as responses (bytes).
REVISIT_FROM = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"


@dataclass
class Archive:
    """The two tables of an archive as they were written."""

    headers: DataFrame
    payloads: DataFrame


def field(name: str, value: Column | str) -> Column:
    """A header line, or nothing for a NULL value; line ends and NUL inside a value are percent-encoded."""
    text = F.lit(value) if isinstance(value, str) else value.cast("string")
    for raw, coded in (("\r", "%0D"), ("\n", "%0A"), ("\0", "%00")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return F.coalesce(F.concat(F.lit(f"{name}: "), text, F.lit(LINE)), F.lit(""))


def record_name(page: Column, row: Column) -> Column:
    """The URN of a record: its page's id, which a NULL leaves empty, and its row number in the archive."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def write_archive(
    pages: DataFrame, kept: Kept, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z", revisit_from: int = REVISIT_FROM,
) -> Archive:
    """Write a record per row: its payload is the column's UTF-8 bytes, a NULL counts as empty.

    Of records with equal payloads of at least `revisit_from` bytes, the one with the smallest id is the response and
    the others revisit it; a NULL id is larger than all others, and of rows that repeat the smallest id one is the
    response. Smaller payloads are all responses. A NULL url leaves its field out. Other columns are not archived. An
    empty table gives an empty archive.

    Two payloads under one digest that differ in length or in an independent hash stop the write."""
    rows = pages.select(
        F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("bytes"),
    ).withColumns({"digest": F.sha2("bytes", 256), "length": F.octet_length("bytes").cast("long")})
    # Row numbers hold once they are written; payload bytes stay out of that table.
    small = kept.write(rows.withColumn("row", F.monotonically_increasing_id()).drop("bytes"))

    mark = F.struct(F.length("bytes").alias("length"), F.xxhash64("bytes").alias("hash"))
    stored = rows.groupBy("digest").agg(F.min("bytes").alias("bytes"), F.min(mark).alias("low"), F.max(mark).alias("high"))
    same = F.assert_true(F.col("low") == F.col("high"), F.concat(F.lit("different payloads under digest "), "digest"))
    payloads = kept.write(stored.where(same.isNull()).select("digest", "bytes"))

    order = F.struct(F.col("page").isNull().alias("none"), "page", "row")
    large = F.col("length") >= revisit_from
    # Only payloads with two records and more have anything to revisit.
    first = small.where(large).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("records")).where(F.col("records") > 1).drop("records")
    told = small.join(first, "digest", "left").withColumn("revisit", F.coalesce(F.col("first.row") != F.col("row"), F.lit(False)))
    headers = kept.write(told.select("page", "row", "digest", head(date).cast("binary").alias("head")))
    kept.drop(small)
    return Archive(headers, payloads)


def head(date: str) -> Column:
    """The head of a record from page, url, digest, length, row, revisit and first: WARC fields, blank line, HTTP fields."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}"), field("Content-Length", F.col("length")), F.lit(LINE),
    )
    revisit = F.col("revisit")
    return F.concat(
        F.lit(f"WARC/1.1{LINE}"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_name(F.col("page"), F.col("row"))), field("WARC-Date", date), field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        field("WARC-Refers-To", F.when(revisit, record_name(F.col("first.page"), F.col("first.row")))), field("WARC-Profile", F.when(revisit, PROFILE)),
        field("Content-Type", "application/http; msgtype=response"),
        field("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("length"))), F.lit(LINE), http,
    )


def records(archive: Archive) -> DataFrame:
    """(head, payload, digest) of every record, put together by digest; a payload whose bytes no longer have their digest, or
    that is missing, stops the job."""
    both = archive.headers.select("head", "digest").join(archive.payloads, "digest", "left")
    sound = F.assert_true(F.coalesce(F.sha2("bytes", 256) == F.col("digest"), F.lit(False)), F.concat(F.lit("no sound payload "), "digest"))
    return both.where(sound.isNull()).select("head", F.col("bytes").alias("payload"), "digest")


def header_value(name: str, head_col: str = "head") -> Column:
    """The first value of a field in a head; NULL if it is absent."""
    got = F.regexp_extract(F.col(head_col).cast("string"), rf"(?:^|\n){name}: ([^\r]*)\r\n", 1)
    return F.nullif(got, F.lit(""))


def read_pages(archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from its bytes: type and ids are read
    in its head, length and digest taken from the payload that the archive gives back."""
    name = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-page:(.*):[0-9]+>$", 1), F.lit("")).cast("long")
    return records(archive).select(
        name(header_value("WARC-Record-ID")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), header_value("WARC-Type").alias("record_type"),
        name(F.coalesce(header_value("WARC-Refers-To"), F.lit(""))).alias("refers_to"),
    )


def export_warc(archive: Archive, path: str, compression: str = "gzip", records_per_file: int = 100_000) -> None:
    """Write plain WARC files of at most `records_per_file` records; two line ends close each record."""
    body = F.when(header_value("WARC-Type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    whole = records(archive).select(F.concat("head", body).cast("string").alias("value"))
    (
        whole.write.option("lineSep", LINE + LINE).option("compression", compression).option("maxRecordsPerFile", records_per_file)
        .mode("overwrite").text(path)
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(head, body) of every record in WARC files: `head` runs through the blank line after the WARC fields, `body` is as
    long as its Content-Length says. A file is read by one task; gzip files may have one member or many."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for data in batch["content"]:
                data = data.as_py()
                if data[:2] == b"\x1f\x8b":
                    members = []
                    while data:
                        one = zlib.decompressobj(31)
                        members.append(one.decompress(data) + one.flush())
                        data = one.unused_data
                    data = b"".join(members)
                at, heads, bodies = 0, [], []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    heads.append(data[at:end])
                    size = next(int(line[15:]) for line in data[at:end].split(b"\r\n") if line[:15].lower() == b"content-length:")
                    bodies.append(data[end:end + size])
                    at = end + size + 4
                    if len(heads) == 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["head", "body"])
                        heads, bodies = [], []
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["head", "body"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "head binary, body binary")
