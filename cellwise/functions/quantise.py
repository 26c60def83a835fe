"""Fixed-point codes of weights, and scaling of values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer types of samples, by the names that options use.
INTEGERS = {"u8": np.uint8, "u16": np.uint16, "u32": np.uint32, "i8": np.int8, "i16": np.int16, "i32": np.int32}


def limits(kind: str) -> tuple[int, int]:
    """The smallest and the largest number of an integer type."""
    if kind not in INTEGERS:
        raise ValueError(f"{kind!r} is none of {sorted(INTEGERS)}")
    found = np.iinfo(INTEGERS[kind])
    return int(found.min), int(found.max)


def promoted(*kinds: str) -> str:
    """The smallest type that holds the numbers of all the given ones."""
    low, high = (f(v) for f, v in zip((min, max), zip(*map(limits, kinds), strict=True), strict=True))
    fits = [k for k in INTEGERS if limits(k)[0] <= low and high <= limits(k)[1]]
    if not fits:
        raise ValueError(f"no type holds {kinds}")
    return min(fits, key=lambda k: limits(k)[1] - limits(k)[0])


def normalise_from(code: Column, kind: str) -> Column:
    """Numbers of an integer type as 0 .. 1."""
    low, high = limits(kind)
    return (code.cast("double") - F.lit(float(low))) / F.lit(float(high - low))


def unnormalise_to(value: Column, kind: str) -> Column:
    """0 .. 1 as numbers of an integer type, halves to even."""
    low, high = limits(kind)
    return F.bround(value * F.lit(float(high - low)) + F.lit(float(low)), 0).cast("long")


def quantise_u16(importance: Column, area: int) -> Column:
    """round(importance / area * 65535) in whole numbers, halves up."""
    return _div(F.lit(2 * 65535).cast("long") * importance + F.lit(area).cast("long"), 2 * area).cast("int")


def _div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b).cast("long"))) / F.lit(b)).cast("long")


def dequantise_u16(code: Column) -> Column:
    return code.cast("double") / F.lit(65535.0)


def quantise_u8(value: Column) -> Column:
    """A share of 1 as 0 .. 255, halves to even."""
    return F.bround(value * F.lit(255.0), 0).cast("int")


def rescale(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low); zero where all values are equal."""
    return F.when(high == low, F.lit(0.0)).otherwise((value - low) / (high - low))
