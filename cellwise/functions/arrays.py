"""Evenly spaced numbers, padding, and dense and sparse arrays of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def linspace_values(low: float, high: float, n: int, integral: bool = False) -> list:
    """n evenly spaced numbers with both ends; one is `low`; cut to integers if asked."""
    if n < 0:
        raise ValueError(f"{n} numbers")
    step = (high - low) / (n - 1) if n > 1 else 0.0
    values = [low + step * i for i in range(n)]
    return [int(v) for v in values] if integral else [float(v) for v in values]


def linspace(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """(i, value, truncated) of n evenly spaced numbers."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    value = F.lit(float(low)) + F.lit(float(step)) * F.col("id")
    return spark.range(n).select(F.col("id").cast("int").alias("i"), value.alias("value"), value.cast("int").alias("truncated"))


def pad_clamp(values: Column, n: int) -> Column:
    """An array made n long by repeating its last element; longer and empty ones stay."""
    missing = F.greatest(F.lit(n) - F.size(values), F.lit(0))
    return F.when(F.size(values) > 0, F.concat(values, F.array_repeat(F.element_at(values, -1), missing))).otherwise(values)


def normalise(value: Column, factor: float) -> Column:
    return value.cast("double") / F.lit(float(factor))


def to_sparse(df: DataFrame, dense: str, ignore=0) -> DataFrame:
    """A row (region, value) for each element of an array column that is not `ignore`."""
    kept = [c for c in df.columns if c != dense]
    return df.select(*kept, F.posexplode(dense).alias("region", "value")).where(F.col("value") != F.lit(ignore))


def to_dense(df: DataFrame, keys: list[str], value: str, region_count: int, fill=0) -> DataFrame:
    """An array `dense` of region_count values for each key, `fill` where a region has no row.

    Grouped maps of at most region_count entries; no join with a spine.
    """
    grouped = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("region", value))).alias("_m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(region_count - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(fill)))
    return grouped.select(*keys, filled.alias("dense"))
