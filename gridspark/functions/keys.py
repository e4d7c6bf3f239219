"""Small Column and key helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.schema import GRID_KEYS


def grain(df: DataFrame, *drop: str) -> list[str]:
    """The key columns of `df` that tell its fields apart."""
    return [k for k in GRID_KEYS if k in df.columns and k not in drop]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int(c: Column) -> Column:
    return F.floor(c).cast("int")


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def close(a: Column, b: Column, tol: float = 1e-8) -> Column:
    return F.abs(a - b) <= tol


def clean(c: str | Column) -> Column:
    """Negative, missing and non-finite values count as zero."""
    c = col(c)
    return F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c).otherwise(F.lit(0.0))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def equal_keys(a: str, b: str, keys: Iterable[str]) -> Column:
    """Equality on keys of two aliased sides."""
    cond = None
    for k in keys:
        c = F.col(f"{a}.{k}") == F.col(f"{b}.{k}")
        cond = c if cond is None else cond & c
    return F.lit(True) if cond is None else cond
