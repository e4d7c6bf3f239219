"""Scans of storm decks to one track schema: SI units, signed degrees, missing values NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.units import convert
from gridspark.sources.text import lines, number, numbered_lines, tokens

COLUMNS = ("storm", "ts", "tau_h", "lon", "lat", "vmax", "pmin", "rmw", "router", "cls", "event")


def _degrees(c: Column, scale: float) -> Column:
    """A number with its hemisphere letter to signed degrees."""
    side = F.upper(F.substring(F.trim(c), -1, 1))
    return F.when(side.isin("S", "W"), -scale).otherwise(scale) * number(F.regexp_extract(c, r"([0-9.]+)", 1))


def _shape(df: DataFrame, **cols: Column) -> DataFrame:
    types = {"storm": "string", "ts": "timestamp", "tau_h": "int", "cls": "string", "event": "string"}
    return df.select(*[cols.get(c, F.lit(None)).cast(types.get(c, "double")).alias(c) for c in COLUMNS])


def _fields(text: str | Column = "text") -> Column:
    return F.transform(F.split(text, ","), lambda v: F.trim(v))


def _when_present(c: Column) -> Column:
    v = number(c)
    return F.when((v != 0) & (v > -99), v)


def scan_tracks(spark: SparkSession, path: str, fmt: str, glob: str = "*") -> DataFrame:
    """Decks of one format (atcf, hurdat, jma, tcvitals, native) from many files."""
    return {"atcf": _atcf, "hurdat": _hurdat, "jma": _jma, "tcvitals": _tcvitals, "native": _native}[fmt](spark, path, glob)


def _atcf(spark, path, glob):
    f = lines(spark, path, glob).where(F.trim("text") != "").select(_fields().alias("f"))
    at = lambda k: F.try_element_at("f", F.lit(k + 1))
    issued = F.to_timestamp(at(2), "yyyyMMddHH")
    lead = at(5).try_cast("int")
    return _shape(
        f, storm=F.concat(at(0), at(1)), ts=issued + F.make_dt_interval(F.lit(0), F.coalesce(lead, F.lit(0))), tau_h=lead,
        lat=_degrees(at(6), 0.1), lon=_degrees(at(7), 0.1), vmax=convert(_when_present(at(8)), "knots", "m/s"),
        pmin=convert(_when_present(at(9)), "mbar", "Pa"), cls=at(10), router=convert(_when_present(at(18)), "nmi", "m"),
        rmw=convert(_when_present(at(19)), "nmi", "m"),
    )


def _hurdat(spark, path, glob):
    """Header lines open a storm; its rows carry on until the next header."""
    from gridspark.functions import running

    ln = numbered_lines(spark, path, glob).where(F.trim("text") != "").withColumn("f", _fields())
    head = F.col("f")[0].rlike(r"^[A-Z]{2}\d+")
    ln = running(ln.withColumn("_id", F.when(head, F.col("f")[0])), ["run", "file"], "line_no", {"storm": ("last", "_id")}).where("_id is null")
    at = lambda k: F.try_element_at("f", F.lit(k + 1))
    event = F.when(at(2) != "", at(2))
    return _shape(
        ln, storm=F.col("storm"), ts=F.to_timestamp(F.concat(at(0), F.lpad(at(1), 4, "0")), "yyyyMMddHHmm"), event=event, cls=at(3),
        lat=_degrees(at(4), 1.0), lon=_degrees(at(5), 1.0), vmax=convert(_when_present(at(6)), "knots", "m/s"), pmin=convert(_when_present(at(7)), "mbar", "Pa"),
    )


def _century(yy: Column) -> Column:
    return F.when(yy.cast("int") >= 51, F.concat(F.lit("19"), yy)).otherwise(F.concat(F.lit("20"), yy))


def _jma(spark, path, glob):
    from gridspark.functions import running

    ln = numbered_lines(spark, path, glob).where(F.trim("text") != "").withColumn("f", tokens())
    head = F.startswith("text", F.lit("66666"))
    ln = running(ln.withColumn("_id", F.when(head, F.trim(F.substring("text", 7, 4)))), ["run", "file"], "line_no", {"storm": ("last", "_id")}).where("_id is null")
    at = lambda k: F.try_element_at("f", F.lit(k + 1))
    when = F.concat(_century(F.substring(at(0), 1, 2)), F.substring(at(0), 3, 6))
    return _shape(
        ln, storm=F.col("storm"), ts=F.to_timestamp(when, "yyyyMMddHH"), cls=at(2), lat=number(at(3)) / 10, lon=number(at(4)) / 10,
        pmin=convert(_when_present(at(5)), "hPa", "Pa"), vmax=convert(_when_present(at(6)), "knots", "m/s"),
    )


def _tcvitals(spark, path, glob):
    f = lines(spark, path, glob).where(F.trim("text") != "").select(tokens().alias("f"))
    at = lambda k: F.try_element_at("f", F.lit(k + 1))
    return _shape(
        f, storm=at(1), ts=F.to_timestamp(F.concat(at(3), F.substring(F.lpad(at(4), 4, "0"), 1, 4)), "yyyyMMddHHmm"), lat=_degrees(at(5), 0.1),
        lon=_degrees(at(6), 0.1), vmax=_when_present(at(12)), pmin=convert(_when_present(at(9)), "mbar", "Pa"),
        rmw=convert(_when_present(at(13)), "km", "m"), router=convert(_when_present(at(11)), "km", "m"),
    )


def _native(spark, path, glob):
    """Count, offset and a blank line, then seconds, lon, lat, wind, its radius, pressure and outer radius."""
    ln = numbered_lines(spark, path, glob)
    offset = ln.where("line_no = 1").select("file", F.try_to_timestamp(F.trim("text")).alias("_at"))
    row = ln.where("line_no >= 2").withColumn("f", F.transform(tokens(), number)).where(F.size("f") >= 7).join(offset, "file")
    at = lambda k: F.when(F.col("f")[k] != -1, F.col("f")[k])
    ts = F.timestamp_millis(F.unix_millis("_at") + F.round(F.col("f")[0] * 1000).cast("long"))
    return _shape(row, storm=F.col("run"), ts=ts, lon=F.col("f")[1], lat=F.col("f")[2], vmax=at(3), rmw=at(4), pmin=at(5), router=at(6))
