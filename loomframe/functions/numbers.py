"""Number theory over long columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Euclid's algorithm needs at most this many steps for 64-bit numbers.
STEPS = 92


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor; gcd(0, 0) = 0; null if either is null."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["x"]))


def lcm(a: Column, b: Column) -> Column:
    """The least common multiple; 0 if either is 0; null if either is null. Whole numbers throughout: doubles end at 2^53."""
    whole = F.abs(a.cast("long") * F.call_function("div", b.cast("long"), gcd(a, b)))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("long")).when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(whole)
