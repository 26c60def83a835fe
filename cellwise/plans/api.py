"""The facade: generate(), splat() and blend() over named generators and ways to estimate occupancy."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.rng import default_seed
from cellwise.operators import coefficients, occupancy, sampling
from cellwise.operators.blend import blend
from cellwise.operators.generators import DiamondSquare, Generator, Uniform, Voronoi
from cellwise.schema import RegionfieldMeta, Window, resolve_window

__all__ = ["DiamondSquare", "Full", "Splatter", "Stochastic", "Stratified", "Systematic", "Uniform", "Voronoi", "blend", "generate", "parse_iterations", "splat"]


class Splatter(Protocol):
    """Counts regions around each centre; norm is what a cell's counts add up to."""

    radius: int

    def importances(self, field: DataFrame, meta: RegionfieldMeta, window: Window) -> tuple[DataFrame, int]: ...


@dataclass(frozen=True)
class Full:
    radius: int = 0
    strategy: str = "auto"

    def importances(self, field: DataFrame, meta: RegionfieldMeta, window: Window) -> tuple[DataFrame, int]:
        return occupancy.full(field, meta, window, self.radius, self.strategy), occupancy.area(self.radius)


@dataclass(frozen=True)
class Systematic:
    radius: int = 0
    first: tuple[int, int] = (0, 0)
    interval: tuple[int, int] = (1, 1)

    def importances(self, field: DataFrame, meta: RegionfieldMeta, window: Window) -> tuple[DataFrame, int]:
        return sampling.systematic(field, meta, window, self.radius, self.first, self.interval)


@dataclass(frozen=True)
class Stratified:
    radius: int = 0
    strata: int = 1
    seed: int = 0

    def importances(self, field: DataFrame, meta: RegionfieldMeta, window: Window) -> tuple[DataFrame, int]:
        return sampling.stratified(field, meta, window, self.radius, self.strata, self.seed)


@dataclass(frozen=True)
class Stochastic:
    radius: int = 0
    samples: int = 1
    seed: int = 0

    def importances(self, field: DataFrame, meta: RegionfieldMeta, window: Window) -> tuple[DataFrame, int]:
        return sampling.stochastic(field, meta, window, self.radius, self.samples, self.seed)


SPLATTERS = {"full": Full, "systematic": Systematic, "stratified": Stratified, "stochastic": Stochastic}
GENERATORS = {"uniform": Uniform, "voronoi": Voronoi, "diamond_square": DiamondSquare}


def generate(spark: SparkSession, meta: RegionfieldMeta, generator: Generator, seed: int | None = None) -> DataFrame:
    """A grid; equal seeds give equal grids, none one from the clock."""
    return generator(spark, meta, default_seed() if seed is None else seed)


def splat(field: DataFrame, meta: RegionfieldMeta, spec: Splatter, offset: tuple[int, int] | None = None, extent: tuple[int, int] | None = None, shape: str = "long", relative: bool = False) -> DataFrame:
    """Weights around each centre of the window: (x, y, region, importance, mask), rows of weight zero absent.

    shape: 'long', 'array' (an array of all regions' masks for each cell) or 'sparse' (structs of those present).
    relative: coordinates count from the offset.
    """
    window = resolve_window(meta, spec.radius, offset, extent)
    counted, norm = spec.importances(field, meta, window)
    weights = occupancy.with_mask(counted, norm)
    if relative:
        weights = weights.withColumn("x", F.col("x") - window.offset[0]).withColumn("y", F.col("y") - window.offset[1])
    if shape == "array":
        return coefficients.dense(weights, meta.region_count, "mask", 0.0)
    if shape == "sparse":
        return coefficients.sparse_arrays(weights, "mask")
    if shape != "long":
        raise ValueError(f"shape {shape!r}")
    return weights


def parse_iterations(text: str) -> tuple[int, ...]:
    """Smoothing passes from runs like '3x0-3x2': three times 0, then three times 2."""
    out: list[int] = []
    for run in text.split("-"):
        times, _, passes = run.partition("x")
        if not times.isdigit() or not passes.isdigit():
            raise ValueError(f"not a run of iterations: {run!r}")
        out += [int(passes)] * int(times)
    return tuple(out)
