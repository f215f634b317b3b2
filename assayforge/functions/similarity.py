"""Fingerprints as one or more 64-bit words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_word(vector: Column, width: int = 64) -> Column:
    """The signs of a vector's first components as the bits of one bigint."""
    bit = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(i) for i in range(width)])


def tanimoto_word(a: Column, b: Column) -> Column:
    """Tanimoto of two 64-bit words; 0 where both are empty."""
    return F.when(a.bitwiseOR(b) != 0, F.bit_count(a.bitwiseAND(b)) / F.bit_count(a.bitwiseOR(b))).otherwise(F.lit(0.0))


def tanimoto(a: Column, b: Column) -> Column:
    """Tanimoto of two arrays of 64-bit words of equal length."""
    count = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))
    either = count(lambda x, y: x.bitwiseOR(y))
    return F.when(either > 0, count(lambda x, y: x.bitwiseAND(y)) / either).otherwise(F.lit(0.0))


def word_bits(word: Column) -> Column:
    """Places of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(word, i) == 1)
