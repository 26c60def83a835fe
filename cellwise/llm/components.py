"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import durable, join_by_weight


def _smallest(pairs: DataFrame, least: Column) -> DataFrame:
    """`m` of each node in `u`: the smallest of its `v`, or what else `least` says."""
    return pairs.groupBy(F.col("u").alias("_key")).agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("_key", least.alias("m"), "_n")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node links its larger neighbours to the smallest of itself and its neighbours."""
    smallest = _smallest(edges.union(edges.select("v", "u")), F.least("_key", "m"))
    return join_by_weight(edges, smallest, "v", 2 * n).select("u", F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of these."""
    smallest = _smallest(edges, F.col("m"))
    others = join_by_weight(edges, smallest, "u", n).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(smallest.select(F.col("_key").alias("u"), F.col("m").alias("v"))).distinct()


def smallest_reachable(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of each node of an edge list: component is the smallest node that it reaches.

    Alternates large and small stars, which are grouped aggregations over edges and never make more of them, until the
    edges stay the same; then each points at the smallest node of its component. Each round is kept in the checkpoint
    folder. Self-links and repeated edges count for nothing; edges with a null end are left out; no edges, no rows.
    """
    now = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL").where("u > v").distinct())
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen, now = state, durable(_small_star(durable(_large_star(now, state[0])), state[0]))
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
