"""What several operators share: reading tables, cutting lineage, words, CRC and size checks."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only up to this many rows; beyond it, joins shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns, of whatever names, are not read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; a folder of our own is set only where none is and all runs in one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cellwise-"))


def release_native(spark: SparkSession) -> bool:
    """Gives native memory that the driver's JVM has freed back to the system; False where the JVM knows no such command.

    Each plan runs in threads of its own (exchanges, broadcasts, compilers), and what these free stays with the allocator's
    arenas, of which there are eight for each core; after some hundred plans that is as much as a small heap.
    """
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    args = new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    kinds = new_array(jvm.java.lang.Class, 4)
    for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = of(kind)
    try:
        # By the interface: the server's own class is not open to reflection.
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def durable(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared checkpoint folder, so that a lost executor loses none of it."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    release_native(df.sparkSession)
    return kept


#: Entries up to which an operator remembers values in a worker process.
REMEMBERED = 200_000

_MEMORIES: list[dict] = []


def memory() -> dict:
    """A dictionary for what an operator remembers in a worker process from task to task."""
    _MEMORIES.append(found := {})
    return found


def only(kept: dict) -> None:
    """Empties the memories of other operators than the one of `kept`, and gives what they held back to the system.

    A worker process serves task after task, of whatever stage, so on an executor all memories would add up.
    """
    others = [m for m in _MEMORIES if m and m is not kept]
    for m in others:
        m.clear()
    if others and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # glibc has it
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def broadcast_if_small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcasting if it has at most `bound` rows (counted by the caller)."""
    return F.broadcast(df) if rows <= bound else df


#: A key of so many rows at least is joined by a broadcast, and so splits.
HEAVY = 1_000


def join_by_weight(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join of `left` and `right`, which has each value of `key` once, in `_key`, and in `_n` how many rows of left have it.

    rows: those of left, or more. Keys of HEAVY rows or more (of more, where there are very many rows) are a small table
    by their number, BROADCAST_ROWS at most, which every task holds; only the rows of the others are shuffled, so no key
    fills a task. The result has left's columns and right's others.
    """
    heavy = max(HEAVY, -(-rows // BROADCAST_ROWS))
    others = [c for c in right.columns if c not in ("_key", "_n")]
    hot = F.broadcast(right.where(F.col("_n") >= heavy).select(F.col("_key").alias("_hot"), F.struct(*others).alias("_found")))
    looked = left.join(hot, F.col(key) == F.col("_hot"), "left")
    found = looked.where("_hot IS NOT NULL").select(*left.columns, *(F.col(f"_found.{c}").alias(c) for c in others))
    cold = looked.where("_hot IS NULL").select(left.columns)
    return found.unionByName(cold.join(right.where(F.col("_n") < heavy), F.col(key) == F.col("_key")).select(*left.columns, *others))


def row_key(doc_id: str, text: str) -> Column:
    """16 bytes that rows share which agree in id and text; a null text counts as empty, a null id as one of its own."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def unsigned_crc32(data: Column) -> Column:
    """CRC-32 as an unsigned long."""
    return F.crc32(data).cast("long")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of `taken`, whatever its case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
