"""Unsigned 64- and 128-bit numbers held in signed longs, as column expressions."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = -(1 << 63)


def as_decimal(x: Column) -> Column:
    """The unsigned value of a long."""
    return F.when(x < 0, x.cast("decimal(20,0)") + F.lit(Decimal(1 << 64))).otherwise(x.cast("decimal(20,0)")).cast("decimal(20,0)")


def as_double(x: Column) -> Column:
    return as_decimal(x).cast("double")


def add(a: Column, b: Column) -> Column:
    """Modulo 2**64, without an overflow in between: the halves are added with their carry."""
    half = (1 << 32) - 1
    low = a.bitwiseAND(F.lit(half)) + b.bitwiseAND(F.lit(half))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(half)))


def compare(high_a: Column, low_a: Column, high_b: Column, low_b: Column) -> Column:
    """-1, 0 or 1, by the unsigned halves."""
    order = lambda a, b, rest: F.when(a.bitwiseXOR(F.lit(TOP)) < b.bitwiseXOR(F.lit(TOP)), -1).when(a == b, rest).otherwise(1)
    return order(high_a, high_b, order(low_a, low_b, F.lit(0)))
