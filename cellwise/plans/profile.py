"""Sweeps of a parameter: each value is run several times to a sink that keeps nothing, and the median is noted."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.arrays import linspace_values

RESULTS = "job_id long, variable int, t_median double, memory long"
INDEX = "job_id long, title string, generator string, splatting string, container string, tag string"
FIRST_JOB = 10_000_000
#: Sweeps' values and sizes.
SWEEPS = {
    "Radius": linspace_values(2, 64, 15, True),
    "GlobalRegionCount": linspace_values(2, 30, 15, True),
    "LocalRegionCount": linspace_values(1, 60, 15, True),
    "Stress": linspace_values(8, 256, 30, True),
}


#: Bounds of an epoch in milliseconds: a run that ends sooner is run again within it, and epochs end after the longest.
SHORTEST, LONGEST = 5.0, 500.0


def time_plan(df: DataFrame, runs: int = 3, warm_up: int = 1, shortest: float = SHORTEST, longest: float = LONGEST) -> float:
    """Median milliseconds of a run to the noop sink, over `runs` epochs after `warm_up` runs.

    An epoch runs the plan until `shortest` has passed and counts by its mean; once epochs have taken `longest` each on
    average, a plan that takes longer than that alone, the rest are left out, but one is always run.
    """
    taken: list[float] = []
    for _ in range(warm_up):
        df.write.format("noop").mode("overwrite").save()
    while len(taken) < runs and (not taken or sum(taken) < longest * runs):
        began, times = time.perf_counter(), 0
        while not times or (time.perf_counter() - began) * 1000 < shortest:
            df.write.format("noop").mode("overwrite").save()
            times += 1
        taken.append((time.perf_counter() - began) * 1000 / times)
    return median(taken)


def result_bytes(df: DataFrame) -> int:
    """The bytes that a result holds, counted from it: 8 for a weight of an array, 16 for an element of a sparse array and 4
    for each cell's offset, 24 for a row (x, y, region, importance, mask)."""
    kinds = dict(df.dtypes)
    if "dense" in kinds:
        found = df.agg(F.sum(F.size("dense").cast("long") * 8))
    elif "elements" in kinds:
        found = df.agg(F.sum(F.size("elements").cast("long") * 16 + 4))
    else:
        found = df.agg(F.count("*") * 24)
    return found.first()[0] or 0


def sweep(spark: SparkSession, job_id: int, values: Iterable[int], plan: Callable[[int], DataFrame], runs: int = 3) -> DataFrame:
    """Results of one job: a row for each value. memory: kB of the result, counted."""
    rows = []
    for v in values:
        df = plan(v)
        rows.append((job_id, v, time_plan(df, runs), -(-result_bytes(df) // 1000)))
    return spark.createDataFrame(rows, RESULTS)


def job_index(spark: SparkSession, titles: Iterable[str], generators: Iterable[str], splattings: Iterable[str], containers: Iterable[str], tag: str = "Default", first: int = FIRST_JOB) -> DataFrame:
    """The product of all choices, numbered."""
    rows = [(first + i, *choice, tag) for i, choice in enumerate(itertools.product(titles, generators, splattings, containers))]
    return spark.createDataFrame(rows, INDEX)


def lookup(index: DataFrame, results: DataFrame, **choice: str) -> DataFrame:
    """Results of the jobs that match, a column of times for each container."""
    chosen = index
    for name, value in choice.items():
        chosen = chosen.where(F.col(name) == value)
    joined = results.join(F.broadcast(chosen), "job_id")
    return joined.groupBy("variable").pivot("container", ["DD", "DS", "SS"]).agg(F.first("t_median"))
