"""Unicode helpers over code points; letters and digits are those of ASCII, and any other character counts as a letter.

Their expressions repeat one class, never a group: Java matches a repeated group by recursion, so a long word would exhaust the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import convert
from .values import text


def is_valid(c: Column) -> Column:
    return F.is_valid_utf8(c)


def count(c: Column) -> Column:
    return F.length(text(c))


def char_bytes(c: Column) -> Column:
    """Bytes of the first character."""
    return F.octet_length(F.substring(text(c), 1, 1))


def slice_of(c: Column, start: int, size: int) -> Column:
    """size code points from start, counted from 0."""
    if start < 0 or size < 0:
        raise ValueError("start and size can't be negative")
    return F.substring(text(c), start + 1, size)


def reverse(c: Column) -> Column:
    return F.reverse(text(c))


def upper(c: Column) -> Column:
    return convert(c, "U")


def lower(c: Column) -> Column:
    return convert(c, "L")


def is_alpha(c: Column) -> Column:
    return text(c).rlike(r"\A[A-Za-z\x{80}-\x{10ffff}]++\z")


def is_digit(c: Column) -> Column:
    return text(c).rlike(r"\A[0-9]++\z")


def is_alnum(c: Column) -> Column:
    return text(c).rlike(r"\A[0-9A-Za-z\x{80}-\x{10ffff}]++\z")


def code_point(c: Column, at: int) -> Column:
    """The code point at a place counted from 0, -1 past the end."""
    return F.when(F.length(text(c)) > at, F.ascii(F.substring(text(c), at + 1, 1))).otherwise(F.lit(-1))


def from_code_point(c: Column) -> Column:
    """The character of a code point; empty where there is no such character."""
    n = c.cast("bigint")
    known = F.when(n.between(0, 0xD7FF) | n.between(0xE000, 0x10FFFF), n)
    return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32"), F.lit(""))
