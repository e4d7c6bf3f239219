"""What the operators on vectors share: which rows take part, blocks of numbers, cosines in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list column without NULLs as rows of doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(v: Column) -> Column:
    """Neither NULL nor empty nor zero, and every component finite."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the usable rows: the smallest array of an id that repeats; a NULL id takes no part.

    Vectors of another length than the most frequent one (the longer of equals) take no part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0)).groupBy("id").agg(F.min("v").alias("v"))


@F.arrow_udf(DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine of two vectors in double precision, the same for the same pair wherever it stands."""
    if not len(a):
        return pa.array([], pa.float64())
    width = len(a[0])
    x, y = matrix(a, width), matrix(b, width)
    return pa.array((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)))


def sample_matrix(vectors: DataFrame, bound: int) -> np.ndarray:
    """At most `bound` vectors (id, v), the first by a hash of the id, as unit rows on the driver."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(bound).select("v").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 1))
    lists = rows["v"].combine_chunks()
    x = matrix(lists, len(lists[0]))
    return x / np.sqrt((x * x).sum(1, keepdims=True))
