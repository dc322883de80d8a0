"""Formula terms as column builders: safe arithmetic with a missing variable read as zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def var(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def divide(left: Column, right: Column) -> Column:
    """Zero where the divisor is as good as zero."""
    return F.when(F.abs(right) > 1e-12, left / right).otherwise(0.0)


def power(base: Column, exponent: Column) -> Column:
    """Exponent cut to [-6, 6]; NULL for a fractional power of a negative number."""
    e = F.greatest(F.least(exponent, F.lit(6.0)), F.lit(-6.0))
    return F.when((base >= 0) | (e == F.floor(e)), F.pow(base, e))


def exp(x: Column) -> Column:
    return F.exp(F.greatest(F.least(x, F.lit(50.0)), F.lit(-50.0)))


def log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-12)))


def sqrt(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def indicator(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def threshold(x: Column, cut: Column) -> Column:
    return indicator(x > cut)


def interaction(x: Column, y: Column) -> Column:
    return x * y


def score(terms: list[Column]) -> Column:
    """Sum of the term values."""
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))
