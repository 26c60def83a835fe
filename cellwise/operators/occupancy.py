"""The share of each cell's square neighbourhood that every region occupies.

All strategies give the same rows (x, y, region, importance): one for each centre of the window and each region in its
neighbourhood. Neighbourhoods lie within the grid. Coordinates are the grid's own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwise.schema import RegionfieldMeta, Window


def diametre(radius: int) -> int:
    return 2 * radius + 1


def area(radius: int) -> int:
    return diametre(radius) ** 2


def within(window: Window, margin: int = 0) -> Column:
    """Rows of the window and `margin` cells around: a range on both axes, which reaches the scan."""
    (ox, oy), (lx, ly) = window.offset, window.last
    return F.col("x").between(ox - margin, lx + margin) & F.col("y").between(oy - margin, ly + margin)


def scatter(field: DataFrame, window: Window, steps_x: list[int], steps_y: list[int]) -> DataFrame:
    """Each cell counts for the centres that see it at one of the given steps; counting starts before the shuffle."""
    margin = max(map(abs, [*steps_x, *steps_y, 0]))
    near = field.where(within(window, margin))
    (ox, oy), (lx, ly) = window.offset, window.last
    seen = near.select("x", "y", "region", F.explode(F.array(*map(F.lit, steps_x))).alias("step")).select((F.col("x") - F.col("step")).alias("x"), "y", "region").where(F.col("x").between(ox, lx))
    seen = seen.select("x", "y", "region", F.explode(F.array(*map(F.lit, steps_y))).alias("step")).select("x", (F.col("y") - F.col("step")).alias("y"), "region").where(F.col("y").between(oy, ly))
    return seen.groupBy("x", "y", "region").agg(F.count("*").alias("importance"))


def full_scatter(field: DataFrame, meta: RegionfieldMeta, window: Window, radius: int) -> DataFrame:
    """Brute force, for small radii and grids with holes: every cell to its (2r + 1)^2 centres."""
    steps = list(range(-radius, radius + 1))
    return scatter(field, window, steps, steps)


def box_1d(counts: DataFrame, along: str, radius: int, low: int, high: int) -> DataFrame:
    """Sums of `n` over 2r + 1 places along one axis, from running sums: the cost does not depend on the radius.

    counts: (x, y, region, n) with a row for each cell and region. Rows outside low .. high are left out.
    """
    across = "y" if along == "x" else "x"
    line = W.partitionBy(across, "region").orderBy(along)
    running = counts.withColumn("_sum", F.sum("n").over(line.rowsBetween(W.unboundedPreceding, 0)))
    box = F.lead("_sum", radius).over(line) - F.coalesce(F.lag("_sum", radius + 1).over(line), F.lit(0))
    return running.select("x", "y", "region", box.alias("n")).where(F.col(along).between(low, high))


def one_hot(field: DataFrame, region_count: int) -> DataFrame:
    """(x, y, region, n) with n 1 for the cell's own region, 0 for each other."""
    regions = F.explode(F.sequence(F.lit(0), F.lit(region_count - 1)))
    return field.select("x", "y", F.col("region").alias("_own"), regions.alias("region")).select("x", "y", "region", (F.col("_own") == F.col("region")).cast("long").alias("n"))


def full_prefix(field: DataFrame, meta: RegionfieldMeta, window: Window, radius: int) -> DataFrame:
    """Separable running sums in SQL windows: along y, then along x. They count rows, so a grid with holes is an error."""
    near = field.where(within(window, radius))
    cells = (window.extent[0] + 2 * radius) * (window.extent[1] + 2 * radius)
    if (have := near.count()) != cells:
        raise ValueError(f"{have} cells where {cells} are needed: running sums take no holes, scatter and tile do")
    hot = one_hot(near, meta.region_count)
    rows = box_1d(hot, "y", radius, window.offset[1], window.last[1])
    both = box_1d(rows, "x", radius, window.offset[0], window.last[0])
    return both.where("n > 0").select("x", "y", "region", F.col("n").alias("importance"))


def tile_size(window: Window, radius: int, cores: int) -> int:
    """The width of tiles: eight radii, so that rims add a small part, but less where that leaves cores without a tile.

    Not under two radii, at which a tile and its rim have four times the tile's cells.
    """
    fair = int((window.extent[0] * window.extent[1] / max(1, cores)) ** 0.5) + 1
    return max(32, 2 * radius, min(max(128, 8 * radius), fair))


def in_tiles(field: DataFrame, window: Window, radius: int, size: int) -> DataFrame:
    """(x, y, region, tx, ty): each cell in every tile whose centres see it."""
    (ox, oy), (lx, ly) = window.offset, window.last

    def tiles(axis: str, low: int, high: int) -> Column:
        of = lambda v: F.floor((v - F.lit(low)) / F.lit(size)).cast("int")
        return F.sequence(of(F.greatest(F.col(axis) - radius, F.lit(low))), of(F.least(F.col(axis) + radius, F.lit(high))))

    near = field.where(within(window, radius))
    return near.select("x", "y", "region", F.explode(tiles("x", ox, lx)).alias("tx")).select("x", "y", "region", "tx", F.explode(tiles("y", oy, ly)).alias("ty"))


def full_tile(field: DataFrame, meta: RegionfieldMeta, window: Window, radius: int, tile: int | None = None) -> DataFrame:
    """Square tiles with a rim of r cells, each summed by integral images: one shuffle, memory by the tile's size."""
    size = tile or tile_size(window, radius, field.sparkSession.sparkContext.defaultParallelism)
    (ox, oy), (lx, ly) = window.offset, window.last

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = ox + int(pdf["tx"].iloc[0]) * size, oy + int(pdf["ty"].iloc[0]) * size
        nx, ny = min(size, lx - x0 + 1), min(size, ly - y0 + 1)
        grid = np.full((nx + 2 * radius, ny + 2 * radius), -1, dtype=np.int16)
        grid[pdf["x"].to_numpy() - x0 + radius, pdf["y"].to_numpy() - y0 + radius] = pdf["region"].to_numpy()
        d, out = diametre(radius), []
        for region in np.unique(grid[grid >= 0]):
            integral = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), dtype=np.int32)
            integral[1:, 1:] = (grid == region).cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32)
            box = integral[d:, d:] - integral[:-d, d:] - integral[d:, :-d] + integral[:-d, :-d]
            i, j = np.nonzero(box)
            out.append(pd.DataFrame({"x": (i + x0).astype("int32"), "y": (j + y0).astype("int32"), "region": np.int32(region), "importance": box[i, j].astype("int64")}))
        return pd.concat(out, ignore_index=True)

    return in_tiles(field, window, radius, size).groupBy("tx", "ty").applyInPandas(sums, "x int, y int, region int, importance long")


STRATEGIES = {"scatter": full_scatter, "prefix": full_prefix, "tile": full_tile}


def choose(radius: int, region_count: int) -> str:
    """scatter up to radius 1 or where neighbourhoods are smaller than the regions' number; tile beyond."""
    return "scatter" if radius <= 1 or region_count > area(radius) else "tile"


def full(field: DataFrame, meta: RegionfieldMeta, window: Window, radius: int, strategy: str = "auto") -> DataFrame:
    return STRATEGIES[choose(radius, meta.region_count) if strategy == "auto" else strategy](field, meta, window, radius)


def with_mask(importances: DataFrame, norm: int) -> DataFrame:
    """Adds mask, the importance as a share of `norm`."""
    return importances.withColumn("mask", F.col("importance").cast("double") / F.lit(float(norm)))
