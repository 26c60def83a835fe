"""Kernels kept up to date from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellwise.operators.coefficients import signed_sums


def start_kernels(deltas: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the kernels of a stream of (keys, region, op, amount) under `path`, as sums of signed amounts by batch.

    Each batch is summed by itself and written to a folder of its own, which a batch that runs again overwrites; so no
    state is held, on the driver or elsewhere, and every change counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        signed_sums(batch, keys, "op", "amount").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return deltas.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_kernels(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The kernels as of the last batch: (keys, region, importance), regions at zero or below left out."""
    sums = spark.read.parquet(path).groupBy(*keys, "region").agg(F.sum("importance").cast("long").alias("importance"))
    return sums.where("importance > 0")


def compact(spark: SparkSession, path: str, keys: list[str], to: str) -> None:
    """All batches of a stopped stream as one, in another folder, from which a new stream can go on."""
    spark.read.parquet(path).groupBy(*keys, "region").agg(F.sum("importance").cast("long").alias("importance")).write.mode("overwrite").parquet(f"{to}/batch=-1")
