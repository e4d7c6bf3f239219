"""Grid, series, track and log relations derived from the driver tables.

Every view uses every row of its table, so its size follows the data: more
embedding rows mean more runs, cases and frames of the same 64 x 50 grid. Values
are floored to multiples of 1/1024, which keeps sums exact in any order. The
SQL text defines the same views for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import Geometry
from gridspark.session import configure

FRAME_GRID = Geometry(0.0, 0.0, 1.0, 1.0, 64, 50)
PATCH_ROWS = "patch int, level int, xlow double, ylow double, dx double, dy double, mx int, my int"

ORACLE_VIEWS = """
e_long as (select vec_id, generate_subscripts(embedding,1)-1 as i, floor(unnest(embedding)::double*1024)/1024 as w from embeddings),
frames as (select concat('r', cast(floor(vec_id/500) as int)) as run, cast(floor(vec_id/50) as int)%10 as frame,
 (cast(floor(vec_id/50) as int)%10)*10.0e0 as t, cast(i as int) as i, cast(vec_id%50 as int) as j, i+0.5e0 as x, vec_id%50+0.5e0 as y,
 greatest(w,0e0) as h, w*0.5e0 as hu, w*w-0.0625e0 as hv, (49-vec_id%50)*0.25e0+i*0.125e0 as b from e_long),
cells as (select concat('r', cast(floor(vec_id/50) as int)) as run, cast(i as int) as i, cast(vec_id%50 as int) as j, i+0.5e0 as x, vec_id%50+0.5e0 as y,
 case when (i*7+vec_id*13)%97=0 then null else w+(49-vec_id%50)*0.25e0+i*0.125e0 end as z from e_long),
ensemble as (select concat('c', cast(floor(vec_id/500) as int)) as "case", concat('m', vec_id%10) as model, cast(i as int) as i,
 cast(floor(vec_id/10) as int)%50 as j, greatest(w,0e0) as v from e_long),
patches as (select distinct concat('r', cast(floor(vec_id/500) as int)) as run, cast(floor(vec_id/100) as int)%5 as frame,
 (cast(floor(vec_id/100) as int)%5)*10.0e0 as t, p.* from embeddings cross join
 (values (1,1,0e0,0e0,1e0,1e0,64,50),(2,2,16e0,10e0,0.5e0,0.5e0,64,50)) p(patch,level,xlow,ylow,dx,dy,mx,my)),
patch_cells as (select concat('r', cast(floor(vec_id/500) as int)) as run, cast(floor(vec_id/100) as int)%5 as frame,
 (cast(floor(vec_id/100) as int)%5)*10.0e0 as t, 1+cast(floor(vec_id/50) as int)%2 as patch, 1+cast(floor(vec_id/50) as int)%2 as level,
 cast(i as int) as i, cast(vec_id%50 as int) as j, greatest(w,0e0) as h, w*0.5e0 as hu, w*w as hv from e_long),
pcx as (select c.*, p.xlow, p.ylow, p.dx, p.dy, p.mx, p.my, p.xlow+(c.i+0.5e0)*p.dx as x, p.ylow+(c.j+0.5e0)*p.dy as y
 from patch_cells c join patches p on p.run=c.run and p.frame=c.frame and p.patch=c.patch),
series as (select user_id as gauge, event_id as sample_no, event_id*1e0 as t, floor(value*64)/64e0 as q1, event_type as kind from events),
tracks as (select user_id as storm, event_id as row_no, event_id%24 as issue_h, event_id%3*6 as tau_h, -90+(event_id%400)*0.125e0 as lon, 10+(event_id%160)*0.125e0 as lat,
 case when event_id%7=0 then 0e0 else floor(value)*1e0 end as vmax, 1010-event_id%90*1e0 as mslp, case when event_type='purchase' then 'L' else '' end as event from events),
log as (select cast(o_custkey as int) as run, o_orderkey as line_no, concat('time t = ',cast(o_orderkey as varchar),'.0D+00, total mass = ',
 cast(cast(floor(o_totalprice) as bigint) as varchar),'.D+00 diff = 0.0D+00') as text from orders)
"""


def oracle(body: str) -> str:
    """An oracle statement over the views; `body` may add its own `name as (...),` parts."""
    text = body.strip()
    if text.lower().startswith("with "):
        return "with recursive " + ORACLE_VIEWS.strip() + ",\n" + text[5:]
    return "with recursive " + ORACLE_VIEWS.strip() + "\n" + text


class Fixtures:
    """The relations as DataFrames for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _values(self) -> DataFrame:
        v = F.col("vec_id")
        return self.table("embeddings").select(v, F.posexplode("embedding").alias("i", "e")).select(
            v, "i", (F.floor(F.col("e").cast("double") * 1024) / F.lit(1024.0)).alias("w")
        )

    @staticmethod
    def _label(prefix: str, n: Column) -> Column:
        return F.concat(F.lit(prefix), n.cast("string"))

    @staticmethod
    def _div(n: int) -> Column:
        return F.floor(F.col("vec_id") / n).cast("int")

    @cached_property
    def frames(self) -> DataFrame:
        v, w, i = F.col("vec_id"), F.col("w"), F.col("i")
        frame = self._div(50) % 10
        return self._values.select(
            self._label("r", self._div(500)).alias("run"),
            frame.alias("frame"),
            (frame * F.lit(10.0)).alias("t"),
            "i",
            (v % 50).cast("int").alias("j"),
            (i + F.lit(0.5)).alias("x"),
            (v % 50 + F.lit(0.5)).alias("y"),
            F.greatest(w, F.lit(0.0)).alias("h"),
            (w * 0.5).alias("hu"),
            (w * w - 0.0625).alias("hv"),
            ((49 - v % 50) * F.lit(0.25) + i * F.lit(0.125)).alias("b"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        v, w, i = F.col("vec_id"), F.col("w"), F.col("i")
        hole = (i * 7 + v * 13) % 97 == 0
        return self._values.select(
            self._label("r", self._div(50)).alias("run"),
            "i",
            (v % 50).cast("int").alias("j"),
            (i + F.lit(0.5)).alias("x"),
            (v % 50 + F.lit(0.5)).alias("y"),
            F.when(~hole, w + (49 - v % 50) * F.lit(0.25) + i * F.lit(0.125)).alias("z"),
        )

    @cached_property
    def grids(self) -> DataFrame:
        """One geometry row per run of `cells`."""
        return self.table("embeddings").select(
            self._label("r", self._div(50)).alias("run"),
            *[F.lit(a).alias(n) for n, a in (("xmin", 0.0), ("xmax", 64.0), ("ymin", 0.0), ("ymax", 50.0))],
            F.lit(64).alias("ncols"), F.lit(50).alias("nrows"), F.lit(1.0).alias("cellsize"),
        ).distinct()

    @cached_property
    def ensemble(self) -> DataFrame:
        v = F.col("vec_id")
        return self._values.select(
            self._label("c", self._div(500)).alias("case"),
            self._label("m", v % 10).alias("model"),
            "i",
            (self._div(10) % 50).alias("j"),
            F.greatest(F.col("w"), F.lit(0.0)).alias("v"),
        )

    @cached_property
    def patches(self) -> DataFrame:
        """Two nested patches per (run, frame): the whole grid, and its middle at half the spacing."""
        frame = self._div(100) % 5
        kinds = F.array(
            *[
                F.struct(
                    F.lit(p).alias("patch"), F.lit(p).alias("level"), F.lit(x).alias("xlow"), F.lit(y).alias("ylow"),
                    F.lit(d).alias("dx"), F.lit(d).alias("dy"), F.lit(64).alias("mx"), F.lit(50).alias("my"),
                )
                for p, x, y, d in ((1, 0.0, 0.0, 1.0), (2, 16.0, 10.0, 0.5))
            ]
        )
        return (
            self.table("embeddings")
            .select(self._label("r", self._div(500)).alias("run"), frame.alias("frame"), (frame * F.lit(10.0)).alias("t"))
            .distinct()
            .select("run", "frame", "t", F.inline(kinds))
        )

    @cached_property
    def patch_cells(self) -> DataFrame:
        v, w = F.col("vec_id"), F.col("w")
        frame, patch = self._div(100) % 5, 1 + self._div(50) % 2
        return self._values.select(
            self._label("r", self._div(500)).alias("run"),
            frame.alias("frame"),
            (frame * F.lit(10.0)).alias("t"),
            patch.alias("patch"),
            patch.alias("level"),
            "i",
            (v % 50).cast("int").alias("j"),
            F.greatest(w, F.lit(0.0)).alias("h"),
            (w * 0.5).alias("hu"),
            (w * w).alias("hv"),
        )

    @cached_property
    def series(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("gauge"),
            F.col("event_id").alias("sample_no"),
            F.col("event_id").cast("double").alias("t"),
            (F.floor(F.col("value") * 64) / F.lit(64.0)).alias("q1"),
            F.col("event_type").alias("kind"),
        )

    @cached_property
    def tracks(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            F.col("user_id").alias("storm"),
            e.alias("row_no"),
            (e % 24).alias("issue_h"),
            (e % 3 * 6).alias("tau_h"),
            (-90 + (e % 400) * F.lit(0.125)).alias("lon"),
            (10 + (e % 160) * F.lit(0.125)).alias("lat"),
            F.when(e % 7 == 0, F.lit(0.0)).otherwise(F.floor("value").cast("double")).alias("vmax"),
            (1010 - (e % 90) * F.lit(1.0)).alias("mslp"),
            F.when(F.col("event_type") == "purchase", "L").otherwise("").alias("event"),
        )

    @cached_property
    def log(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").cast("int").alias("run"),
            F.col("o_orderkey").alias("line_no"),
            F.concat(
                F.lit("time t = "), F.col("o_orderkey").cast("string"), F.lit(".0D+00, total mass = "),
                F.floor("o_totalprice").cast("string"), F.lit(".D+00 diff = 0.0D+00"),
            ).alias("text"),
        )
