"""Bits of binary values as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word(value: Column, i: int) -> Column:
    """Bytes 8i .. 8i+7 as a long."""
    digits = F.hex(F.substring(value, 8 * i + 1, 8))
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming_bits(a: Column, b: Column, size: int) -> Column:
    """Number of bits in which two values of ``size`` bytes (a multiple of 8) differ; null for other sizes."""
    bits = F.bit_count(word(a, 0).bitwiseXOR(word(b, 0)))
    for i in range(1, size // 8):
        bits = bits + F.bit_count(word(a, i).bitwiseXOR(word(b, i)))
    return F.when((F.octet_length(a) == size) & (F.octet_length(b) == size), bits.cast("int"))
