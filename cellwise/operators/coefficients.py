"""Weights by cell and region: kernels built from changes, dense and sparse shapes, offsets, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwise.functions.arrays import to_dense


def increments(deltas: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """The sum of amounts for each key and region."""
    return deltas.groupBy(*keys, "region").agg(F.sum(amount).cast("long").alias("importance"))


def signed_sums(deltas: DataFrame, keys: list[str], op: str, amount: str) -> DataFrame:
    """Sums of amounts that op 'inc' adds and 'dec' takes away."""
    signed = F.when(F.col(op) == "inc", F.col(amount)).otherwise(-F.col(amount))
    return deltas.groupBy(*keys, "region").agg(F.sum(signed).cast("long").alias("importance"))


def apply_deltas(deltas: DataFrame, keys: list[str], op: str, amount: str) -> DataFrame:
    """Signed sums; regions that end at zero or below have no row."""
    return signed_sums(deltas, keys, op, amount).where("importance > 0")


def dense(weights: DataFrame, region_count: int, value: str = "importance", fill=0) -> DataFrame:
    """(x, y, dense): an array of all regions' weights for each cell."""
    return to_dense(weights, ["x", "y"], value, region_count, fill)


def sparse_arrays(weights: DataFrame, value: str = "importance") -> DataFrame:
    """(x, y, elements): structs (region, value) for each cell, by region."""
    return weights.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("region", F.col(value).alias("value")))).alias("elements"))


def region_counts(weights: DataFrame) -> DataFrame:
    """How many regions each neighbourhood has."""
    return weights.groupBy("x", "y").agg(F.count("*").alias("regions"))


def row_offsets(weights: DataFrame) -> DataFrame:
    """(x, y, begin, end) of each cell's elements in the packed order of cells, x outer.

    Running counts within each x, over the running counts of all x: only one row for each x meets in one task.
    """
    counts = region_counts(weights)
    line = W.partitionBy("x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    inside = counts.withColumn("_end", F.sum("regions").over(line))
    lines = counts.groupBy("x").agg(F.sum("regions").alias("_n"))
    before = lines.select(F.col("x").alias("_x"), F.coalesce(F.sum("_n").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = inside.join(before, F.col("x") == F.col("_x"))
    return joined.select("x", "y", (F.col("_before") + F.col("_end") - F.col("regions")).alias("begin"), (F.col("_before") + F.col("_end")).alias("end"))


def sizes(weights: DataFrame, region_count: int) -> DataFrame:
    """One row: cells, elements and the bytes of dense (8 each) and sparse (16 an element, 4 an offset) shapes."""
    per_cell = region_counts(weights)
    total = per_cell.agg(F.count("*").alias("cells"), F.sum("regions").cast("long").alias("elements"))
    return total.select("cells", "elements", (F.col("cells") * region_count * 8).alias("dense_bytes"), (F.col("elements") * 16 + (F.col("cells") + 1) * 4).alias("sparse_bytes"))
