"""Mathematical functions: the value read as a whole number (else 0); results that aren't finite are empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import number_text, wholenum


def number(c: Column) -> Column:
    return F.coalesce(wholenum(c), F.lit(0.0))


def zabs(c: Column) -> Column:
    return number_text(F.abs(number(c)))


def arccos(c: Column) -> Column:
    return number_text(F.acos(number(c)))


def arcsin(c: Column) -> Column:
    return number_text(F.asin(number(c)))


def arctan(c: Column) -> Column:
    return number_text(F.atan(number(c)))


def cos(c: Column) -> Column:
    return number_text(F.cos(number(c)))


def exp(c: Column) -> Column:
    return number_text(F.exp(number(c)))


def ln(c: Column) -> Column:
    return number_text(F.ln(number(c)))


def power(base: Column, exponent: Column) -> Column:
    return number_text(F.pow(number(base), number(exponent)))


def sin(c: Column) -> Column:
    return number_text(F.sin(number(c)))


def sqrt(c: Column) -> Column:
    return number_text(F.sqrt(number(c)))


def tan(c: Column) -> Column:
    return number_text(F.tan(number(c)))


def bit(c: Column, b: int) -> Column:
    """Bit b, from 0, of a whole number."""
    return F.when(F.lit(0 <= b < 64), F.getbit(number(c).cast("bigint"), F.lit(min(max(b, 0), 63))).cast("int")).otherwise(F.lit(0))


def random(n: Column, seed: int | None = None) -> Column:
    """A whole number from 0 to n - 1; 0 if n isn't positive."""
    return F.when(n > 0, F.floor(F.rand(seed) * n)).otherwise(F.lit(0)).cast("bigint")


def uuid() -> Column:
    """A random version 4 UUID."""
    return F.uuid()
