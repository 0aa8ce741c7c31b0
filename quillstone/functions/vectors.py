"""Vector and score functions as columns; sums are in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays. The sum of squares is made once, not for each value."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x, lambda s: F.transform(v, lambda x: F.when(s > 0, x / F.sqrt(s)).otherwise(x.cast("double"))))


def sign_words(v: Column) -> Column:
    """Sign bits in 64-bit words, first value in the highest bit."""
    bits = F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0"))
    word = lambda w: F.conv(F.array_join(F.slice(bits, w * 64 + 1, F.lit(64)), ""), 2, -10).cast("bigint")
    return F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / 64).cast("int")), word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("long")


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
