"""Occupancy estimated from samples of the neighbourhood: on a lattice, one for each stratum, or at random."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.rng import hash_u32, uniform_int
from cellwise.operators.occupancy import diametre, in_tiles, scatter, tile_size, within
from cellwise.schema import RegionfieldMeta, Window

TAG = "splat"


def lattice(radius: int, first: tuple[int, int], interval: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Steps from the centre to the lattice's places on both axes."""
    d = diametre(radius)
    if min(first) < 0 or max(first) >= d or min(interval) < 1:
        raise ValueError(f"first {first} and interval {interval} for a neighbourhood {d} wide")
    return tuple([p - radius for p in range(f, d, i)] for f, i in zip(first, interval, strict=True))


def systematic(field: DataFrame, meta: RegionfieldMeta, window: Window, radius: int, first: tuple[int, int] = (0, 0), interval: tuple[int, int] = (1, 1)) -> tuple[DataFrame, int]:
    """Counts on the lattice first + k * interval of each neighbourhood, and the number of its places."""
    steps_x, steps_y = lattice(radius, first, interval)
    return scatter(field, window, steps_x, steps_y), len(steps_x) * len(steps_y)


def _at_samples(field: DataFrame, window: Window, radius: int, steps: Column) -> DataFrame:
    """Counts of the regions at some places of each centre's neighbourhood.

    steps: for a centre, an array of places, numbered x outer from the neighbourhood's first cell. Cells go to tiles with
    a rim, a centre's places with its cell, so there is one shuffle of cells, whatever the number of samples; regions are
    looked up in the tile's grid.
    """
    size, d = tile_size(window, radius, field.sparkSession.sparkContext.defaultParallelism), diametre(radius)
    (ox, oy), (lx, ly) = window.offset, window.last
    tile = lambda axis, low: F.floor((F.col(axis) - F.lit(low)) / F.lit(size)).cast("int")
    own = within(window) & (F.col("tx") == tile("x", ox)) & (F.col("ty") == tile("y", oy))
    dealt = in_tiles(field, window, radius, size).withColumn("steps", F.when(own, steps))

    def counts(table: pa.Table) -> pa.Table:
        x, y, region, tx, ty = (table.column(c).to_numpy() for c in ("x", "y", "region", "tx", "ty"))
        x0, y0 = ox + int(tx[0]) * size - radius, oy + int(ty[0]) * size - radius
        grid = np.full((min(size + 2 * radius, lx + radius - x0 + 1), min(size + 2 * radius, ly + radius - y0 + 1)), -1, dtype=np.int32)
        grid[x - x0, y - y0] = region
        at = table.column("steps").combine_chunks()
        centre = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        places = at.drop_null()
        each = np.repeat(centre, places.value_lengths().to_numpy())
        step = places.flatten().to_numpy()
        seen = grid[x[each] - x0 - radius + step // d, y[each] - y0 - radius + step % d]
        most = int(region.max()) + 1
        key, n = np.unique(each[seen >= 0] * most + seen[seen >= 0], return_counts=True)
        return pa.table({"x": x[key // most], "y": y[key // most], "region": (key % most).astype(np.int32), "importance": n.astype(np.int64)})

    return dealt.groupBy("tx", "ty").applyInArrow(counts, "x int, y int, region int, importance long")


def stratified(field: DataFrame, meta: RegionfieldMeta, window: Window, radius: int, strata: int = 1, seed: int = 0) -> tuple[DataFrame, int]:
    """Counts of one sample from each of strata x strata parts of each neighbourhood.

    Parts have whole bounds i * d div strata; a part without a cell of its own takes the one at its begin. Random bits
    depend on the seed, the neighbourhood's first cell and the part.
    """
    if strata < 1:
        raise ValueError(f"{strata} strata")
    d = diametre(radius)
    x0, y0 = F.col("x") - radius, F.col("y") - radius
    part = lambda v: F.floor(v * d / F.lit(strata)).cast("int")

    def place(i: Column, j: Column, axis: int) -> Column:
        begin, end = part((i, j)[axis]), part((i, j)[axis] + 1)
        bits = hash_u32(seed, f"{TAG}:stratified", x0, y0, i, j, axis)
        return F.least(begin + F.shiftright(bits * F.greatest(end - begin, F.lit(1)), 32).cast("int"), F.lit(d - 1))

    def step(k: Column) -> Column:
        i, j = F.floor(k / F.lit(strata)).cast("int"), k % strata
        return place(i, j, 0) * d + place(i, j, 1)

    steps = F.transform(F.sequence(F.lit(0), F.lit(strata * strata - 1)), step)
    return _at_samples(field, window, radius, steps), strata * strata


def stochastic(field: DataFrame, meta: RegionfieldMeta, window: Window, radius: int, samples: int = 1, seed: int = 0) -> tuple[DataFrame, int]:
    """Counts of `samples` uniform draws with replacement from each neighbourhood; bits by seed, first cell and draw."""
    if samples < 1:
        raise ValueError(f"{samples} samples")
    d = diametre(radius)
    x0, y0 = F.col("x") - radius, F.col("y") - radius
    place = lambda k, axis: uniform_int(hash_u32(seed, f"{TAG}:stochastic", x0, y0, k, axis), d)
    steps = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: place(k, 0) * d + place(k, 1))
    return _at_samples(field, window, radius, steps), samples
