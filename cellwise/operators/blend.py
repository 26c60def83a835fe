"""Blending of feature layers by weights, and stretching and coding of the result."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions.quantise import limits, rescale, unnormalise_to

#: The numbers that masks carry for the ways to make them.
ALGORITHMS = {"full": 0, "stochastic": 1, "stratified": 2, "systematic": 3}


def union_of(masks: Mapping[str, DataFrame]) -> DataFrame:
    """The masks of several algorithms in one table, with the column `algorithm`."""
    parts = [df.withColumn("algorithm", F.lit(ALGORITHMS[name])) for name, df in masks.items()]
    return reduce(DataFrame.unionByName, parts)


def blend(masks: DataFrame, features: DataFrame, value: str = "value", norm: str = "norm") -> DataFrame:
    """Sum over regions of weight times feature, for each algorithm, cell and channel.

    masks: (algorithm, x, y, region, importance, norm); features: (region, x, y, channel, value). Sums of whole numbers
    and decimals are exact, those of fractions are doubles; they are divided once. An equi-join on the cell and region,
    then sums that start before the shuffle.
    """
    joined = masks.join(features, ["x", "y", "region"])
    sums = joined.groupBy("algorithm", "x", "y", "channel", norm).agg(F.sum(F.col("importance") * F.col(value)).alias("_sum"))
    return sums.select("algorithm", "x", "y", "channel", (F.col("_sum").cast("double") / F.col(norm).cast("double")).alias("value"))


def stretched(blended: DataFrame) -> DataFrame:
    """Values over all algorithms, cells and channels stretched to 0 .. 1; the two ends are one row, broadcast."""
    ends = blended.agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    return blended.join(F.broadcast(ends)).withColumn("value", rescale(F.col("value"), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def quantised(blended: DataFrame, kind: str = "u8", stretch: bool = True) -> DataFrame:
    """Values as numbers of an integer type, stretched over all of it unless they are in 0 .. 1 already. The type for features
    of several types is promoted() of theirs."""
    return (stretched(blended) if stretch else blended).withColumn("value", unnormalise_to(F.col("value"), kind).cast("int" if limits(kind)[1] < 1 << 31 else "long"))
