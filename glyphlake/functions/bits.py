"""Bit strings as columns of 64-bit numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount_xor(pairs) -> Column:
    """Hamming distance of hashes given as pairs of 64-bit columns; null where a side is null."""
    return reduce(lambda a, b: a + b, [F.bit_count(a.bitwiseXOR(b)) for a, b in pairs])


def half(hex_digits: Column) -> Column:
    """8 hex digits as a number."""
    return F.conv(hex_digits, 16, 10).cast("long")


def from_hex(text: Column, at: int = 0) -> Column:
    """16 hex digits from place ``at`` on, as a signed 64-bit number made of two halves."""
    return F.shiftleft(half(F.substring(text, at + 1, 8)), 32).bitwiseOR(half(F.substring(text, at + 9, 8)))


def words256(text: Column) -> list[Column]:
    return [from_hex(text, 16 * k) for k in range(4)]


def is_hash(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$")


def hex_distance(a: Column, b: Column) -> Column:
    """Of two 64-digit hashes; null unless both are such."""
    return F.when(is_hash(a) & is_hash(b), popcount_xor(zip(words256(a), words256(b))))


def packed(flags: Column, first: int = 0, bits: int = 64) -> Column:
    """64 flags from place ``first`` of an array, first flag as the highest bit."""
    own = F.slice(flags, first + 1, bits)
    return F.aggregate(own, F.lit(0).cast("long"), lambda h, f: F.shiftleft(h, 1).bitwiseOR(F.when(f, 1).otherwise(0).cast("long")))
