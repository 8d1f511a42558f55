"""The expression operators: Columns of values in, a Column of values out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import collation, flag, number_text, numprefix, text, truthy, wholenum


def minus(a: Column) -> Column:
    return number_text(F.negate(numprefix(a)) + F.lit(0.0), finite=True)


def plus(a: Column) -> Column:
    return number_text(numprefix(a), finite=True)


def negation(a: Column) -> Column:
    return flag(~truthy(a))


def both(a: Column, b: Column) -> Column:
    return flag(truthy(a) & truthy(b))


def either(a: Column, b: Column) -> Column:
    return flag(truthy(a) | truthy(b))


def add(a: Column, b: Column) -> Column:
    return number_text(numprefix(a) + numprefix(b))


def subtract(a: Column, b: Column) -> Column:
    return number_text(numprefix(a) - numprefix(b))


def multiply(a: Column, b: Column) -> Column:
    return number_text(numprefix(a) * numprefix(b))


def _quotient(a: Column, b: Column) -> Column:
    """The quotient, null where b is zero."""
    return F.try_divide(numprefix(a), numprefix(b))


def divide(a: Column, b: Column) -> Column:
    """Division by zero gives 0."""
    return number_text(F.coalesce(_quotient(a, b), F.lit(0.0)))


def int_divide(a: Column, b: Column) -> Column:
    """The quotient cut towards zero; division by zero gives 0."""
    q = F.coalesce(_quotient(a, b), F.lit(0.0))
    return number_text(F.signum(q) * F.floor(F.abs(q)) + F.lit(0.0))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; modulo zero gives 0."""
    return number_text(F.coalesce(numprefix(a) - numprefix(b) * F.floor(_quotient(a, b)), F.lit(0.0)))


def power(a: Column, b: Column) -> Column:
    return number_text(F.pow(numprefix(a), numprefix(b)))


def concat(a: Column, b: Column) -> Column:
    return F.concat(text(a), text(b))


def _compared(a: Column, b: Column, by: str) -> Column:
    """Compares numbers where both are, else strings by bytes."""
    x, y = wholenum(a), wholenum(b)
    ops = {"=": lambda p, q: p == q, "<": lambda p, q: p < q, ">": lambda p, q: p > q}
    return F.when(x.isNotNull() & y.isNotNull(), ops[by](x, y)).otherwise(ops[by](text(a), text(b)))


def equal(a: Column, b: Column) -> Column:
    return flag(_compared(a, b, "="))


def unequal(a: Column, b: Column) -> Column:
    return flag(~_compared(a, b, "="))


def less(a: Column, b: Column) -> Column:
    return flag(_compared(a, b, "<"))


def greater(a: Column, b: Column) -> Column:
    return flag(_compared(a, b, ">"))


def not_less(a: Column, b: Column) -> Column:
    return flag(~_compared(a, b, "<"))


def not_greater(a: Column, b: Column) -> Column:
    return flag(~_compared(a, b, ">"))


def follows(a: Column, b: Column) -> Column:
    return flag(text(a) > text(b))


def not_follows(a: Column, b: Column) -> Column:
    return flag(text(a) <= text(b))


def contains(a: Column, b: Column) -> Column:
    return flag(F.contains(text(a), text(b)))


def not_contains(a: Column, b: Column) -> Column:
    return flag(~F.contains(text(a), text(b)))


def sorts_after(a: Column, b: Column) -> Column:
    return flag(collation(text(a)) > collation(text(b)))


def not_sorts_after(a: Column, b: Column) -> Column:
    return flag(~(collation(text(a)) > collation(text(b))))
