"""Connected regions of cells.

Rows of selected cells collapse into runs first; only runs are iterated over. Each
round hooks every component onto its smallest neighbour and halves label chains, so
rounds grow with the logarithm of the longest chain. Rounds end in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import Geometry, grain
from gridspark.session import checkpoint_dir

# Label of a run: its row above, its first column below; sorts by row, then column.
SHIFT = 1 << 32


def row_runs(selected: DataFrame) -> DataFrame:
    """Selected cells with the first column `_i0` of their unbroken row run."""
    by = grain(selected)
    w = Window.partitionBy(*by, "j").orderBy("i")
    start = F.when(F.lag("i").over(w) == F.col("i") - 1, F.lit(None)).otherwise(F.col("i"))
    return selected.withColumn("_s", start).withColumn("_i0", F.last("_s", ignorenulls=True).over(w)).drop("_s")


def _label(i0: Column, j: Column) -> Column:
    return j.cast("long") * F.lit(SHIFT) + i0


def run_links(cells: DataFrame, conn: int = 4) -> DataFrame:
    """Pairs (a, b) of touching runs in neighbouring rows, each pair once."""
    by = grain(cells)
    w = Window.partitionBy(*by, "i").orderBy("j")
    below = F.when(F.lag("j").over(w) == F.col("j") - 1, F.lag("_i0").over(w))
    t = cells.withColumn("_below", below).where("_below is not null")
    # The first column two runs share stands for the pair.
    links = t.where(F.col("i") == F.greatest("_i0", "_below")).select(
        *by, _label(F.col("_below"), F.col("j") - 1).alias("a"), _label(F.col("_i0"), F.col("j")).alias("b")
    )
    if conn == 4:
        return links
    if conn != 8:
        raise ValueError("conn is 4 or 8")
    runs = cells.groupBy(*by, "j", "_i0").agg(F.max("i").alias("_i1"))
    up = runs.select(*by, (F.col("j") + 1).alias("j"), _label(F.col("_i0"), F.col("j")).alias("a"), F.col("_i0").alias("_p0"), F.col("_i1").alias("_p1"))
    here = runs.withColumn("b", _label(F.col("_i0"), F.col("j")))
    right = here.join(up.withColumn("_i0", F.col("_p1") + 1), [*by, "j", "_i0"]).select(*by, "a", "b")
    left = here.join(up.withColumn("_i1", F.col("_p0") - 1), [*by, "j", "_i1"]).select(*by, "a", "b")
    return links.unionByName(right).unionByName(left)


def components(nodes: DataFrame, links: DataFrame, by: list[str], rounds: int = 64) -> DataFrame:
    """(by, id, label): the smallest id of each node's component."""
    checkpoint_dir(nodes.sparkSession)
    both = links.select(*by, F.col("a").alias("s"), F.col("b").alias("d")).unionByName(
        links.select(*by, F.col("b").alias("s"), F.col("a").alias("d"))
    ).checkpoint()
    state = nodes.select(*by, "id", F.col("id").alias("label")).checkpoint()
    for _ in range(rounds):
        lab = lambda key, name: state.select(*by, F.col("id").alias(key), F.col("label").alias(name))
        # Smallest label next to each node, offered to the node and to its present root.
        near = both.join(lab("d", "_l"), [*by, "d"]).groupBy(*by, "s").agg(F.min("_l").alias("_l"))
        near = near.withColumnRenamed("s", "id").join(state, [*by, "id"])
        offers = near.select(*by, "id", "_l").unionByName(near.select(*by, F.col("label").alias("id"), "_l"))
        offers = offers.groupBy(*by, "id").agg(F.min("_l").alias("_l"))
        hooked = state.join(offers, [*by, "id"], "left").select(
            *by, "id", F.col("label").alias("_old"), F.least("label", F.coalesce("_l", "label")).alias("label")
        )
        jump = hooked.select(*by, F.col("id").alias("label"), F.col("label").alias("_up"))
        new = hooked.join(jump, [*by, "label"]).select(*by, "id", "_old", F.least("label", "_up").alias("label")).checkpoint()
        changed = not new.where("label <> _old").isEmpty()
        state = new.drop("_old")
        if not changed:
            return state
    raise ValueError("regions did not settle")


def label_cells(selected: DataFrame, conn: int = 4) -> DataFrame:
    """Selected cells with the `label` of their region."""
    by = grain(selected)
    runs = row_runs(selected)
    nodes = runs.select(*by, _label(F.col("_i0"), F.col("j")).alias("id")).distinct()
    labels = components(nodes, run_links(runs, conn), by).withColumnRenamed("id", "_id")
    return runs.withColumn("_id", _label(F.col("_i0"), F.col("j"))).join(labels, [*by, "_id"]).drop("_id", "_i0")


def connected_region(
    cells: DataFrame, seeds: DataFrame, level: float, grids: DataFrame | None = None, errors: str = "raise"
) -> DataFrame:
    """Cells at or below `level` joined to a seed (run, i, j) through shared sides.

    Given `grids`, a region reaching its grid's edge is not closed. A seed on higher
    or missing ground and an open region are errors, or with errors="report" rows of
    (run, issue) instead of cells.
    """
    by = grain(cells)
    low = cells.where(F.col("z") <= level)
    labelled = label_cells(low)
    seed = seeds.select(*by, "i", "j").distinct()
    chosen = labelled.join(seed, [*by, "i", "j"], "left_semi").select(*by, "label").distinct()
    region = labelled.join(chosen, [*by, "label"], "left_semi")
    high = seed.join(low.select(*by, "i", "j"), [*by, "i", "j"], "left_anti").select(*by, F.lit("seed above the level").alias("issue"))
    issues = high.distinct()
    if grids is not None:
        g = grids.select("run", "ncols", "nrows")
        edge = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == F.col("ncols") - 1) | (F.col("j") == F.col("nrows") - 1)
        open_ = region.join(g, "run").where(edge).select(*by, F.lit("region reaches the edge").alias("issue")).distinct()
        issues = issues.unionByName(open_)
    if errors == "report":
        return issues
    if errors == "raise":
        bad = issues.first()
        if bad is not None:
            raise ValueError(f"{bad['issue']} in {[bad[k] for k in by]}")
    return region.drop("label")


def flood_select(
    cells: DataFrame, z1: float, z2: float, mask: Column | None = None, previous: Column | None = None, max_iters: int | None = None
) -> DataFrame:
    """`chosen`: cells beyond z1 and everything up to z2 reached from them through shared sides.

    z1 <= z2 selects below (z < z1, then z < z2), else above. `previous` replaces the
    first selection. Masked cells are left as they are. `max_iters` limits the steps.
    """
    by = grain(cells)
    free = F.lit(True) if mask is None else ~F.coalesce(mask, F.lit(False))
    z = F.col("z")
    first, second = (z < z1, z < z2) if z1 <= z2 else (z > z1, z > z2)
    seed = F.coalesce(first & free, F.lit(False)) if previous is None else F.coalesce(previous, F.lit(False))
    base = cells.withColumns({"_seed": seed, "_may": F.coalesce(second & free, F.lit(False))})
    if max_iters is None:
        labelled = label_cells(base.where("_seed or _may").select(*by, "i", "j", "_seed"))
        chosen = labelled.where("_seed").select(*by, "label").distinct()
        hit = labelled.join(chosen, [*by, "label"], "left_semi").select(*by, "i", "j", F.lit(True).alias("chosen"))
    else:
        checkpoint_dir(cells.sparkSession)
        hit = base.where("_seed").select(*by, "i", "j").checkpoint()
        front = hit
        # Cells still to reach; the front never looks at others.
        rest = base.where("_may and not _seed").select(*by, "i", "j").checkpoint()
        step = F.array(*[F.struct(F.lit(a).alias("_di"), F.lit(b).alias("_dj")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])
        for _ in range(max_iters):
            near = front.select(*by, "i", "j", F.inline(step)).select(
                *by, (F.col("i") + F.col("_di")).alias("i"), (F.col("j") + F.col("_dj")).alias("j")
            )
            front = rest.join(near, [*by, "i", "j"], "left_semi").checkpoint()
            if front.isEmpty():
                break
            rest = rest.join(front, [*by, "i", "j"], "left_anti").checkpoint()
            hit = hit.unionByName(front)
        hit = hit.withColumn("chosen", F.lit(True))
    return cells.join(hit, [*by, "i", "j"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def label_regions(selected: DataFrame, grid: Geometry, conn: int = 4) -> DataFrame:
    """One row per region: label, cells, index box and number of boundary sides."""
    from gridspark.operators.geometry import shoreline_faces

    by = grain(selected)
    cells = label_cells(selected.select(*by, "i", "j"), conn)
    # Regions never touch by a side, so a side open to any unselected cell bounds its own region.
    faces = shoreline_faces(selected.select(*by, "i", "j"), grid).withColumns(
        {"i": grid.column(F.col("target_x")), "j": grid.row(F.col("target_y"))}
    )
    sides = faces.groupBy(*by, "i", "j").agg(F.count("*").alias("_n"))
    return cells.join(sides, [*by, "i", "j"], "left").groupBy(*by, "label").agg(
        F.count("*").alias("cells"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("sides"),
    )


def region_edges(selected: DataFrame, grid: Geometry, conn: int = 4) -> DataFrame:
    """Boundary sides of every region: its label with each face's centre, normal and length."""
    from gridspark.operators.geometry import shoreline_faces

    by = grain(selected)
    cells = label_cells(selected.select(*by, "i", "j"), conn).select(
        *by, "label", (grid.xmin + (F.col("i") + F.lit(0.5)) * grid.dx).alias("target_x"), (grid.ymin + (F.col("j") + F.lit(0.5)) * grid.dy).alias("target_y")
    )
    return shoreline_faces(selected.select(*by, "i", "j"), grid).join(cells, [*by, "target_x", "target_y"])
