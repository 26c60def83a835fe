"""Rendezvous hashing of record keys over weighted shards, on DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.llm.common import broadcast_if_small, durable, unsigned_crc32

#: 52 bits of an MD5 digest make a fraction that a double holds exactly.
HASH_HEX, HASH_SPAN = 13, float(1 << 52)


def shard_scores(key: Column, weights: Mapping[int, float]) -> list[tuple[int, Column]]:
    """The score -weight / ln(u) of each shard; u in (0, 1) comes from the key and the shard alone."""
    scores = []
    for shard, weight in sorted(weights.items()):
        digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(shard))).cast("binary"))
        u = (F.conv(F.substring(digest, 1, HASH_HEX), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(HASH_SPAN)
        scores.append((shard, F.lit(-float(weight)) / F.log(u)))
    return scores


def rendezvous_shard(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard with the highest score; of equal scores, the lower shard.

    A null key is hashed as the empty string. Another shard, or more weight for one, moves rows only into that shard.
    """
    ranked = [F.struct(score.alias("score"), F.lit(-shard).alias("order")) for shard, score in shard_scores(F.coalesce(key.cast("string"), F.lit("")), weights)]
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    return (-best["order"]).cast("int")


#: Digests are counted by their first bits, to find keys that a great many rows share.
FIRST_BITS = 12


def _crowds(keys: DataFrame, total: int, counts: dict[int, int], rows_per_bucket: int) -> DataFrame | None:
    """(m, subs) of each digest that over `rows_per_bucket` rows share: how many parts they are cut into. None if there is none.

    keys: m, the digests. Only those are counted one by one whose first bits are too frequent.
    """
    full = [first for first, n in counts.items() if n > rows_per_bucket and n > 2 * total >> FIRST_BITS]
    if not full:
        return None
    each = keys.where(F.shiftright("m", 52 - FIRST_BITS).isin(full)).groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > rows_per_bucket)
    crowds = durable(each.select("m", F.ceil(F.col("n") / rows_per_bucket).alias("subs")))
    return None if crowds.isEmpty() else crowds


def number_within(df: DataFrame, group: str, groups: int, key: str, spread: str, ties: list[str], slot: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Adds `slot`: numbers 0, 1, 2, ... within each value of `group` (of which there are `groups` at most), in order of
    the key's MD5, then `spread`, the key and `ties`.

    spread: a column of 32 evenly spread bits. One group may hold any share of the rows, so it is cut into ranges of the
    digest of about `rows_per_bucket` rows, and a key that more rows share (such as null) into ranges of `spread`. Counts,
    one row for each range, give every range its first number; slots do not depend on the ranges. Rows equal in all of
    these are interchangeable. df may have any columns.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    mixed = F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_HEX), 16, 10).cast("long")
    keys = df.select(mixed.alias("m"))
    counts = {r["first"]: r["n"] for r in keys.groupBy(F.shiftright("m", 52 - FIRST_BITS).alias("first")).agg(F.count("*").alias("n")).collect()}  # 4096 rows at most
    total = sum(counts.values())
    buckets = max(1, -(-total // rows_per_bucket))
    bucket = lambda m: F.shiftright(F.shiftright(m, 22) * F.lit(buckets).cast("long"), 30)
    whole = df.select(F.struct("*").alias("row"), F.col(group).alias("g"), mixed.alias("m"), F.col(spread).cast("long").alias("spread"), F.col(key).alias("key"), *(F.col(t).alias(f"tie{i}") for i, t in enumerate(ties)))
    cut = whole.withColumn("bucket", bucket(F.col("m")))
    crowds = _crowds(keys, total, counts, rows_per_bucket)
    if crowds is None:
        cut = cut.withColumns({"segment": F.lit(0), "sub": F.lit(0).cast("long")})
    else:
        # Crowds of a bucket in order: the rows between them are even segments, they are the odd ones.
        listed = crowds.groupBy(bucket(F.col("m")).alias("crowded_bucket")).agg(F.array_sort(F.collect_list(F.struct("m", "subs"))).alias("crowds"))
        cut = cut.join(broadcast_if_small(listed, -(-total // rows_per_bucket)), F.col("bucket") == F.col("crowded_bucket"), "left")
        own = F.filter("crowds", lambda c: c["m"] == F.col("m"))
        before = F.coalesce(F.size(F.filter("crowds", lambda c: c["m"] < F.col("m"))), F.lit(0))
        crowded = F.coalesce(F.size(own) > 0, F.lit(False))
        cut = cut.withColumns({"segment": F.when(F.col("crowds").isNull(), 0).otherwise(2 * before + crowded.cast("int")), "sub": F.when(crowded, F.shiftright(F.col("spread") * F.get(own, F.lit(0))["subs"], 32)).otherwise(F.lit(0))})
    at = ("g", "bucket", "segment", "sub")
    sizes = cut.groupBy(*at).agg(F.count("*").alias("n"))
    # A window per group over one row for each range: rows / rows_per_bucket of them.
    before = Window.partitionBy("g").orderBy("bucket", "segment", "sub").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*(F.col(c).alias(f"_{c}") for c in at), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = Window.partitionBy(*at).orderBy("m", "spread", F.col("key").asc_nulls_last(), *(f"tie{i}" for i in range(len(ties))))
    numbered = cut.withColumn("local", F.row_number().over(local) - 1)
    same = [F.col(c) == F.col(f"_{c}") for c in at]
    joined = numbered.join(broadcast_if_small(first, 3 * buckets * groups), same[0] & same[1] & same[2] & same[3])
    return joined.select("row.*", (F.col("first") + F.col("local")).cast("long").alias(slot))


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Mapping[int, float] | None = None, grow_by: float | None = 1.0, rows_per_bucket: int = 50_000) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row.

    weights: shard number to weight; 24 equal shards if not given. grow_by: the weight of one more shard, which
    grown_shard takes into account; None leaves grown_shard null. A null text has no bytes, so size 8 and CRC 0; rows
    with a null key go to the shard of the empty key. Repeated rows stay, each with a slot of its own. An empty table
    gives no rows. Other columns are not carried.
    """
    weights = dict(weights or {shard: 1.0 for shard in range(24)})
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    out = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        unsigned_crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col(key), weights).alias("shard"),
        (rendezvous_shard(F.col(key), weights | {max(weights) + 1: grow_by}) if grow_by else F.lit(None).cast("int")).alias("grown_shard"),
    )
    numbered = number_within(out, "shard", len(weights), key, "text_crc32", ["size"], "slot", rows_per_bucket)
    return numbered.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_sizes(assigned: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


