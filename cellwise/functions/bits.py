"""Bits for a sample, packing of samples into words, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BitsPerSample:
    """Samples of `bits`, a power of two, in words of `word` bits."""

    bits: int
    word: int = 8

    def __post_init__(self):
        if self.bits < 1 or self.bits & (self.bits - 1) or self.bits > self.word:
            raise ValueError(f"{self.bits} bits a sample in {self.word}")

    @property
    def factor(self) -> int:
        return self.word // self.bits

    @property
    def log2(self) -> int:
        return self.bits.bit_length() - 1

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1


def minimum_bits(largest: int) -> int:
    """Bits for values up to `largest`, made a power of two; one at least."""
    need = max(1, largest.bit_length())
    return 1 << (need - 1).bit_length()


def minimum_bits_of(largest: Column) -> Column:
    """The same of a column."""
    need = F.greatest(F.length(F.bin(largest)), F.lit(1))
    return F.when(need == 1, 1).otherwise(F.pow(F.lit(2), F.ceil(F.log2(need.cast("double"))))).cast("int")


def bit_pack(samples: Column, bits: int, factor: int) -> Column:
    """Words (longs) of `factor` samples, the first in the highest bits; the last sample fills the last word."""
    words = F.ceil(F.size(samples) / F.lit(factor)).cast("int")
    padded = F.concat(samples, F.array_repeat(F.element_at(samples, -1), words * F.lit(factor) - F.size(samples)))
    return F.transform(F.sequence(F.lit(0), words - 1), lambda w: F.aggregate(F.slice(padded, w * F.lit(factor) + 1, F.lit(factor)), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, bits).bitwiseOR(v.cast("long"))))


def bit_unpack(words: Column, size: Column, bits: int, factor: int) -> Column:
    """The first `size` samples of packed words."""
    mask = (1 << bits) - 1

    def sample(i: Column) -> Column:
        down = F.lit(bits) * (F.lit(factor - 1) - F.pmod(i, F.lit(factor)))
        return F.call_function("shiftright", F.element_at(words, F.floor(i / F.lit(factor)).cast("int") + 1), down.cast("int")).bitwiseAND(F.lit(mask).cast("long")).cast("int")

    return F.transform(F.sequence(F.lit(0), size - 1), sample)
