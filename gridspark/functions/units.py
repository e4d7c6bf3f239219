"""Unit tables and conversion expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius in metres used for degree lengths and great circles (fixed value).
EARTH_RADIUS = 6367.5e3
METRES_PER_DEGREE = EARTH_RADIUS * math.pi / 180.0

# Factor to the standard unit of each kind (fixed values).
FACTORS = {
    "length": {"m": 1.0, "cm": 1e-2, "km": 1e3, "miles": 1609.34, "nmi": 1852.0, "lat-long": METRES_PER_DEGREE},
    "pressure": {
        "Pa": 1.0, "hPa": 1e2, "KPa": 1e3, "MPa": 1e6, "GPa": 1e9, "mbar": 1e2,
        "dyne/cm^2": 0.1, "dyne/m^2": 1e-5,
    },
    "speed": {"m/s": 1.0, "knots": 0.51444444, "km/h": 1e3 / 3600.0, "mph": 0.44704},
    "moment": {"N-m": 1.0, "dyne-cm": 1e-7},
}
# Scale and offset to Celsius; the sign for kelvin is the physical one.
TEMPERATURES = {"C": (1.0, 0.0), "F": (5.0 / 9.0, -160.0 / 9.0), "K": (1.0, -273.15)}


def kind_of(unit: str) -> str:
    for kind, units in (*FACTORS.items(), ("temperature", TEMPERATURES)):
        if unit in units:
            return kind
    raise ValueError(f"unit {unit!r} is not known")


def scale_offset(old: str, new: str) -> tuple[float, float]:
    """`new = scale * old + offset`; an error when the units measure different things."""
    kind = kind_of(old)
    if kind_of(new) != kind:
        raise ValueError(f"{old!r} measures {kind}, {new!r} measures {kind_of(new)}")
    if kind != "temperature":
        return FACTORS[kind][old] / FACTORS[kind][new], 0.0
    (a, b), (c, d) = TEMPERATURES[old], TEMPERATURES[new]
    return a / c, (b - d) / c


def convert(value: Column, old: str, new: str) -> Column:
    scale, offset = scale_offset(old, new)
    return value * F.lit(scale) + F.lit(offset) if offset else value * F.lit(scale)


def convert_by_column(value: Column, unit: Column, new: str) -> Column:
    """As `convert`, with the unit named per row; an unknown or foreign unit fails the job."""
    kind = kind_of(new)
    units = TEMPERATURES if kind == "temperature" else FACTORS[kind]
    out = F.raise_error(F.concat(F.lit("no conversion to " + new + " from "), unit)).cast("double")
    for name in units:
        out = F.when(unit == name, convert(value, name, new)).otherwise(out)
    return F.when(value.isNull() | unit.isNull(), F.lit(None).cast("double")).otherwise(out)
