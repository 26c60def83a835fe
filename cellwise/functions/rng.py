"""Random numbers that depend on a seed, a tag and keys alone, so on no partitioning and no order."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column
from pyspark.sql import functions as F


def default_seed() -> int:
    """A seed from the clock, for those who give none."""
    return time.time_ns() % (1 << 63)


def hash_u32(seed: int, tag: str, *keys: Column | int) -> Column:
    """32 random bits (as a long) of the keys: the first 8 hex digits of MD5 over 'seed:tag:key:...'."""
    parts = [F.lit(str(seed)), F.lit(tag), *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def hash_u32_sql(seed: int, tag: str, *keys: str | int) -> str:
    """The same in DuckDB's SQL."""
    parts = ", ".join([f"'{seed}'", f"'{tag}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 8) AS BIGINT)"


def hash_u32_value(seed: int, tag: str, *keys: int) -> int:
    """The same of plain numbers."""
    return int(hashlib.md5(":".join(map(str, (seed, tag, *keys))).encode()).hexdigest()[:8], 16)


def uniform_int(bits: Column, n: int) -> Column:
    """One of 0 .. n - 1."""
    if n < 1:
        raise ValueError(f"nothing to choose from: {n}")
    return F.pmod(bits, F.lit(n)).cast("int")
