"""Grids as tables: transposition, slices, lines as arrays, equality, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.schema import RegionfieldMeta


def transpose(field: DataFrame) -> DataFrame:
    return field.select(F.col("y").alias("x"), F.col("x").alias("y"), "region")


def slice2d(field: DataFrame, offset: tuple[int, int], extent: tuple[int, int]) -> DataFrame:
    """The cells of a rectangle; what of it lies outside the grid is left out."""
    return field.where(F.col("x").between(offset[0], offset[0] + extent[0] - 1) & F.col("y").between(offset[1], offset[1] + extent[1] - 1))


def lines(field: DataFrame, axis: str) -> DataFrame:
    """An array `regions` for each row (axis x) or column (axis y), in order of the other axis."""
    other = "y" if axis == "x" else "x"
    return field.groupBy(axis).agg(F.transform(F.array_sort(F.collect_list(F.struct(other, "region"))), lambda s: s["region"]).alias("regions"))


def extent(field: DataFrame) -> DataFrame:
    """One row: width, height and cells."""
    return field.agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count("*").alias("cells"))


def extremes(field: DataFrame, height: int) -> DataFrame:
    """One row: the lowest and highest region, and the first cell of the lowest, counted in columns of `height`, x outer."""
    cell = F.col("x").cast("long") * height + F.col("y")
    return field.agg(F.min("region").alias("lowest"), F.max("region").alias("highest"), F.min_by(cell, F.struct("region", cell)).alias("first_lowest"))


def equal(a: DataFrame, b: DataFrame, regions: tuple[int, int] | None = None) -> DataFrame:
    """One row: whether two grids have the same cells, each as often, and the same number of regions, if both are given.

    Counted by one grouping, not by two set differences.
    """
    same = F.lit(regions is None or regions[0] == regions[1])
    sides = a.select("x", "y", "region", F.lit(1).alias("n")).unionByName(b.select("x", "y", "region", F.lit(-1).alias("n")))
    differ = sides.groupBy("x", "y", "region").agg(F.sum("n").alias("n")).where("n <> 0")
    return differ.agg(((F.count("*") == 0) & same).alias("equal"))


def tile_spine(spark: SparkSession, meta: RegionfieldMeta, tile: tuple[int, int]) -> DataFrame:
    """(tile_x, tile_y, x0, y0) of each tile over the extent, y fastest."""
    if min(tile) < 1:
        raise ValueError(f"tile {tile}")
    nx, ny = -(-meta.width // tile[0]), -(-meta.height // tile[1])
    at = spark.range(nx * ny).select(F.floor(F.col("id") / ny).cast("int").alias("tile_x"), F.pmod("id", F.lit(ny)).cast("int").alias("tile_y"))
    return at.withColumn("x0", F.col("tile_x") * tile[0]).withColumn("y0", F.col("tile_y") * tile[1])


def with_tiles(field: DataFrame, tile: tuple[int, int]) -> DataFrame:
    """Adds tile_x and tile_y, by which grids are partitioned at rest."""
    of = lambda axis, size: F.floor(F.col(axis) / F.lit(size)).cast("int")
    return field.withColumn("tile_x", of("x", tile[0])).withColumn("tile_y", of("y", tile[1]))


def to_tiles(field: DataFrame, meta: RegionfieldMeta, tile: tuple[int, int]) -> DataFrame:
    """(tile_x, tile_y, i, j, region): whole tiles, whose places beyond the grid repeat its edge.

    Each cell knows the places that it fills, so nothing is joined: an edge cell fills the padding beyond it.
    """
    nx, ny = -(-meta.width // tile[0]), -(-meta.height // tile[1])

    def places(axis: str, last: int, end: int) -> Column:
        return F.when(F.col(axis) == last, F.sequence(F.lit(last), F.lit(end - 1))).otherwise(F.array(F.col(axis)))

    filled = field.select(F.explode(places("x", meta.width - 1, nx * tile[0])).alias("x"), "y", "region")
    filled = filled.select("x", F.explode(places("y", meta.height - 1, ny * tile[1])).alias("y"), "region")
    return with_tiles(filled, tile).select("tile_x", "tile_y", F.pmod("x", F.lit(tile[0])).alias("i"), F.pmod("y", F.lit(tile[1])).alias("j"), "region")


def from_tiles(tiles: DataFrame, meta: RegionfieldMeta, tile: tuple[int, int]) -> DataFrame:
    """The grid of whole tiles, without padding."""
    cells = tiles.select((F.col("tile_x") * tile[0] + F.col("i")).alias("x"), (F.col("tile_y") * tile[1] + F.col("j")).alias("y"), "region")
    return cells.where((F.col("x") < meta.width) & (F.col("y") < meta.height))
