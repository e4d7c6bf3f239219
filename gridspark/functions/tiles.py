"""Square tiles with a halo, and regular-grid index arithmetic.

Neighbourhood operators need cells from both directions. A row window and a
column window would shuffle the whole table twice, and a single huge frame would
sit in one task. Here each cell goes to its own tile and, near a tile edge, also
to the next one; one shuffle by tile then serves every window inside it, and no
task holds more than (tile + 2 halo)^2 cells of a field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.keys import grain, to_int

TILE = 512


@dataclass(frozen=True)
class Geometry:
    """A regular grid: outer lower edges, spacing and cell counts."""

    xmin: float
    ymin: float
    dx: float
    dy: float
    ncols: int
    nrows: int

    @property
    def xmax(self) -> float:
        return self.xmin + self.ncols * self.dx

    @property
    def ymax(self) -> float:
        return self.ymin + self.nrows * self.dy

    def column(self, x: Column) -> Column:
        return to_int((x - F.lit(self.xmin)) / F.lit(self.dx))

    def row(self, y: Column) -> Column:
        return to_int((y - F.lit(self.ymin)) / F.lit(self.dy))

    def contains(self, x: Column, y: Column) -> Column:
        return (
            (x >= self.xmin) & (x < self.xmax) & (y >= self.ymin) & (y < self.ymax)
        )


def halo_tiles(cells: DataFrame, halo: int, tile: int = TILE, by: list[str] | None = None) -> DataFrame:
    """Cells spread over tiles and shuffled by tile; `_own` marks each cell's home tile."""
    by = grain(cells) if by is None else by
    if tile <= halo:
        raise ValueError("a tile must be wider than its halo")

    def spread(c: str) -> Column:
        at = F.col(c)
        return F.explode(F.sequence(to_int((at - halo) / tile), to_int((at + halo) / tile)))

    return (
        cells.withColumn("_ti", spread("i"))
        .withColumn("_tj", spread("j"))
        .withColumn(
            "_own",
            (F.col("_ti") == to_int(F.col("i") / tile)) & (F.col("_tj") == to_int(F.col("j") / tile)),
        )
        .repartition(*by, "_ti", "_tj")
    )


def home(df: DataFrame) -> DataFrame:
    """Keep each cell once, in its own tile, and drop the tile columns."""
    return df.where("_own").drop("_ti", "_tj", "_own")
