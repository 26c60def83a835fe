"""Grids from tables, and grids, masks and results at rest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.operators.blend import union_of
from cellwise.operators.raster import with_tiles

#: Parquet's codecs by the names that options use. LZW is TIFF's alone.
COMPRESSION = {"none": "uncompressed", "snappy": "snappy", "zstd": "zstd"}


def codec(name: str) -> str:
    if name not in COMPRESSION:
        raise ValueError(f"tables are not compressed by {name!r}, but by one of {sorted(COMPRESSION)}")
    return COMPRESSION[name]


def field_from(df: DataFrame, index: Column, height: int, region: Column) -> DataFrame:
    """A grid of `height` columns from rows numbered 0, 1, 2, ...: x outer, y inner."""
    return df.select(F.floor(index / F.lit(height)).cast("int").alias("x"), F.pmod(index, F.lit(height)).cast("int").alias("y"), region.cast("int").alias("region"))


def write_field(field: DataFrame, path: str, tile: tuple[int, int] = (512, 512), compression: str = "zstd") -> None:
    """Parquet partitioned by tiles, which readers of a window prune."""
    with_tiles(field, tile).write.mode("overwrite").option("compression", codec(compression)).partitionBy("tile_x", "tile_y").parquet(path)


def read_field(spark: SparkSession, path: str, tile: tuple[int, int] = (512, 512), window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A grid at rest; window (first x, last x, first y, last y) reads its tiles alone."""
    df = spark.read.schema("x int, y int, region int, tile_x int, tile_y int").parquet(path)
    if window:
        x0, x1, y0, y1 = window
        df = df.where(F.col("tile_x").between(x0 // tile[0], x1 // tile[0]) & F.col("tile_y").between(y0 // tile[1], y1 // tile[1])).where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return df.drop("tile_x", "tile_y")


def write_masks(masks: Mapping[str, DataFrame], path: str, compression: str = "zstd") -> None:
    """Masks of several algorithms, partitioned by algorithm and region."""
    union_of(masks).write.mode("overwrite").option("compression", codec(compression)).partitionBy("algorithm", "region").parquet(path)


#: The columns of the index of results, as they are named at rest.
INDEX = {"job_id": "job id", "title": "job title", "generator": "regionfield generator name", "splatting": "splatting name", "container": "container trait tag", "tag": "custom tag"}


def write_results(results: DataFrame, path: str) -> None:
    """Profile results as CSV with a header, a folder for each job; milliseconds with two decimals, kB with none."""
    shown = results.select("job_id", "variable", F.format_string("%.2f", "t_median").alias("t_median"), F.format_string("%d", "memory").alias("memory"))
    shown.write.mode("overwrite").option("header", True).partitionBy("job_id").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("variable int, t_median double, memory long, job_id long").csv(path)


def write_index(index: DataFrame, path: str) -> None:
    """The index of results as CSV with a header."""
    index.select(*(F.col(c).alias(name) for c, name in INDEX.items())).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{name}` {'long' if c == 'job_id' else 'string'}" for c, name in INDEX.items())
    return spark.read.option("header", True).schema(schema).csv(path).withColumnsRenamed({name: c for c, name in INDEX.items()})
