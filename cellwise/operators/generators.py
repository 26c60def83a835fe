"""Grids of regions made from a seed: uniform, Voronoi, diamond-square; nearest resizing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwise.functions.rng import hash_u32, hash_u32_value, uniform_int
from cellwise.schema import RegionfieldMeta

TAG = "gen"


class Generator(Protocol):
    """Makes a complete grid for a meta and a seed."""

    def __call__(self, spark: SparkSession, meta: RegionfieldMeta, seed: int) -> DataFrame: ...


def cells(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(idx, x, y) of each cell, x outer."""
    return spark.range(width * height).select(F.col("id").alias("idx"), F.floor(F.col("id") / height).cast("int").alias("x"), F.pmod("id", F.lit(height)).cast("int").alias("y"))


@dataclass(frozen=True)
class Uniform:
    """Each cell's region is independent of the others'."""

    def __call__(self, spark: SparkSession, meta: RegionfieldMeta, seed: int) -> DataFrame:
        return cells(spark, meta.width, meta.height).select("x", "y", uniform_int(hash_u32(seed, f"{TAG}:uniform", F.col("idx")), meta.region_count).alias("region"))


def centroid_rows(meta: RegionfieldMeta, count: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(id, cx, cy, region) of each centroid; those on one cell have one region."""
    if count < 1:
        raise ValueError(f"{count} centroids")
    places = [(i, hash_u32_value(seed, f"{TAG}:centroid:x", i) % meta.width, hash_u32_value(seed, f"{TAG}:centroid:y", i) % meta.height) for i in range(count)]
    return [(i, x, y, hash_u32_value(seed, f"{TAG}:centroid:region", x, y) % meta.region_count) for i, x, y in places]


def centroids(spark: SparkSession, meta: RegionfieldMeta, count: int, seed: int) -> DataFrame:
    """The same as a table, made by Spark."""
    placed = spark.range(count).select(F.col("id").cast("int").alias("id"), uniform_int(hash_u32(seed, f"{TAG}:centroid:x", F.col("id")), meta.width).alias("cx"), uniform_int(hash_u32(seed, f"{TAG}:centroid:y", F.col("id")), meta.height).alias("cy"))
    return placed.withColumn("region", uniform_int(hash_u32(seed, f"{TAG}:centroid:region", F.col("cx"), F.col("cy")), meta.region_count))


def nearest(points: Sequence[tuple[int, int, int, int]]) -> Column:
    """Struct (d2, id, region) of the point nearest to (x, y), by whole squared distances; of equal ones, the lower id.

    The points are few (a parameter of the generator) and stand in the plan, so nothing is joined.
    """
    listed = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(x).alias("cx"), F.lit(y).alias("cy"), F.lit(r).alias("region")) for i, x, y, r in points))
    square = lambda v: v.cast("long") * v.cast("long")
    return F.array_min(F.transform(listed, lambda p: F.struct((square(F.col("x") - p["cx"]) + square(F.col("y") - p["cy"])).alias("d2"), p["id"].alias("id"), p["region"].alias("region"))))


@dataclass(frozen=True)
class Voronoi:
    """Each cell has the region of its nearest centroid."""

    centroids: int = 1

    def __call__(self, spark: SparkSession, meta: RegionfieldMeta, seed: int) -> DataFrame:
        return cells(spark, meta.width, meta.height).select("x", "y", nearest(centroid_rows(meta, self.centroids, seed))["region"].alias("region"))


def _coin(seed: int, tag: str, *keys: Column | int) -> Column:
    return hash_u32(seed, f"{TAG}:{tag}", *keys).bitwiseAND(F.lit(1).cast("long")).cast("int")


def parent(x: Column, y: Column, level: int, seed: int) -> tuple[Column, Column]:
    """The cell one level up that (x, y) copies: between two parents, a coin for each axis decides."""
    up = lambda v, axis: (F.shiftright(v, 1) + v.bitwiseAND(F.lit(1)) * _coin(seed, f"up:{level}", x, y, axis)).cast("int")
    return up(x, 0), up(y, 1)


def grown(n: int, levels: int) -> int:
    for _ in range(levels):
        n = 2 * n - 1
    return n


def upscale(spark: SparkSession, field: DataFrame, size: tuple[int, int], seed: int, first_level: int = 0, levels: int = 1) -> DataFrame:
    """Doubles the resolution `levels` times: cells trace their parents back in one projection, then one join."""
    width, height = (grown(n, levels) for n in size)
    traced = cells(spark, width, height).select("x", "y", F.col("x").alias("px"), F.col("y").alias("py"))
    for level in range(first_level + levels - 1, first_level - 1, -1):
        px, py = parent(F.col("px"), F.col("py"), level, seed)
        traced = traced.select("x", "y", px.alias("px"), py.alias("py"))
    source = field.select(F.col("x").alias("px"), F.col("y").alias("py"), "region")
    return traced.join(source, ["px", "py"]).select("x", "y", "region")


def smooth(field: DataFrame, size: tuple[int, int], seed: int, tag: str) -> DataFrame:
    """Inner cells between equal neighbours take their region: north and south, east and west; if both, a coin decides."""
    along_y, along_x = W.partitionBy("x").orderBy("y"), W.partitionBy("y").orderBy("x")
    near = field.select("x", "y", "region", F.lag("region").over(along_y).alias("w"), F.lead("region").over(along_y).alias("e"))
    near = near.select("*", F.lag("region").over(along_x).alias("n"), F.lead("region").over(along_x).alias("s"))
    inner = (F.col("x") > 0) & (F.col("x") < size[0] - 1) & (F.col("y") > 0) & (F.col("y") < size[1] - 1)
    both = F.when(_coin(seed, f"smooth:{tag}", F.col("x"), F.col("y")) == 0, F.col("n")).otherwise(F.col("e"))
    pairs = F.when((F.col("e") == F.col("w")) & (F.col("n") == F.col("s")), both).when(F.col("e") == F.col("w"), F.col("e")).when(F.col("n") == F.col("s"), F.col("n")).otherwise(F.col("region"))
    return near.select("x", "y", F.when(inner, pairs).otherwise(F.col("region")).alias("region"))


@dataclass(frozen=True)
class DiamondSquare:
    """A small uniform grid, upscaled once for each iteration, with as many smoothing passes as the iteration says."""

    initial: tuple[int, int] = (2, 2)
    iterations: tuple[int, ...] = (0,)

    def __call__(self, spark: SparkSession, meta: RegionfieldMeta, seed: int) -> DataFrame:
        if min(self.initial) < 2 or not self.iterations or min(self.iterations) < 0:
            raise ValueError(f"initial extent {self.initial}, iterations {self.iterations}")
        size = self.initial
        field = Uniform()(spark, RegionfieldMeta(*size, meta.region_count), seed)
        level = 0
        while level < len(self.iterations):
            # Upscales without smoothing between them are one projection.
            run = next((i for i in range(level, len(self.iterations)) if self.iterations[i]), len(self.iterations) - 1) - level + 1
            field = upscale(spark, field, size, seed, level, run)
            size, level = tuple(grown(n, run) for n in size), level + run
            for p in range(self.iterations[level - 1]):
                field = smooth(field, size, seed, f"{level - 1}:{p}")
        return field if size == (meta.width, meta.height) else resize(spark, field, size, (meta.width, meta.height))

    @property
    def size(self) -> tuple[int, int]:
        return tuple(grown(n, len(self.iterations)) for n in self.initial)


def resize(spark: SparkSession, field: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Nearest cells: round(i / last_out * last_in) in whole numbers, halves up; a single row or column takes the first."""

    def source(v: Column, have: int, want: int) -> Column:
        if want == 1:
            return F.lit(0)
        return F.floor((F.lit(2 * (have - 1)).cast("long") * v + F.lit(want - 1)) / F.lit(2 * (want - 1))).cast("int")

    wanted = cells(spark, *to).select("x", "y", source(F.col("x"), size[0], to[0]).alias("px"), source(F.col("y"), size[1], to[1]).alias("py"))
    return wanted.join(field.select(F.col("x").alias("px"), F.col("y").alias("py"), "region"), ["px", "py"]).select("x", "y", "region")
