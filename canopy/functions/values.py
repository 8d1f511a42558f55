"""String-typed values: numeric reading, canonical number text, truth, and collation.

A value is a string. Three readings as a number exist and differ: the longest numeric prefix (arithmetic, truth), the
whole text (comparison, loop bounds) and a canonical test. Missing values read as the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the value model.
PREFIX = r"^([+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:E[+-]?\d+)?)"
WHOLE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
SUBSCRIPT = r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
CANONICAL = r"^ *-?\d+(\.\d+)?(E[+-]?\d+)? *\z"
#: Integers below this are exact in a double.
EXACT = 9007199254740992.0


INFINITY = float("inf")


def text(c: Column) -> Column:
    """A value as a string; null reads as empty."""
    return c if "_number" in c.__dict__ else F.coalesce(c.cast("string"), F.lit(""))


def _digits_only(s: Column) -> Column:
    """Whether a string is digits with at most one point and a minus before them, as most numbers are: no expression need read it."""
    rest = F.translate(s, "0123456789", "")
    return rest.isin("", ".") | (rest.isin("-", "-.") & s.startswith("-"))


def _rarely(c: Column, f) -> Column:
    """f of a Column that few rows need: a higher-order function, whose code is small and whose argument is bound once."""
    return F.transform(F.array(c), f)[0]


def _read(s: Column, pattern: str, group: int) -> Column:
    """The number that a string is or, by the pattern, holds; null if there is none."""
    return F.when(_digits_only(s), s.try_cast("double")).otherwise(_rarely(s, lambda x: F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group).try_cast("double"))))


def numprefix(c: Column) -> Column:
    """The number that a value begins with, else 0."""
    return c._number if "_number" in c.__dict__ else F.coalesce(_read(text(c), PREFIX, 1), F.lit(0.0))


def wholenum(c: Column) -> Column:
    """The number that the whole value is, else null."""
    return c._finite if "_finite" in c.__dict__ else _read(text(c), WHOLE, 0)


def is_canonical(c: Column) -> Column:
    """Whether a value is a plain decimal number, spaces around it allowed."""
    return text(c).rlike(CANONICAL)


def number_text(v: Column, finite: bool = False) -> Column:
    """A double as canonical text: integers without a point, no exponent, no trailing zeros, no zero before the point.

    Null and numbers that aren't finite (none, if so stated) give the empty string. Arithmetic on the result takes the number itself, so that
    nested expressions neither print nor read what is between.
    """
    size, shown = F.abs(v), v.cast("string")
    out = (
        F.when((v == F.floor(v)) & (size < EXACT), v.cast("bigint").cast("string"))
        # from a thousandth to ten millions doubles are shown without an exponent
        .when((size >= 1) & (size < 1e7), shown)
        .when((v >= 1e-3) & (v < 1), F.substring(shown, 2, 24))
        .when((v <= -1e-3) & (v > -1), F.concat(F.lit("-"), F.substring(shown, 3, 24)))
        .when((v <= -1) & (v > -1e7), shown)
        .otherwise(_rarely(v, _number_text))
    )
    out._finite = v if finite else F.when(size < INFINITY, v)
    out._number = v if finite else F.coalesce(out._finite, F.lit(0.0))
    return out


def _number_text(v: Column) -> Column:
    """Any number as text, by the digits that it is shown with and the place of its point."""
    shown = v.cast("string")
    digits = F.translate(F.substring_index(shown, "E", 1), "-.", "")
    digits = F.rtrim(F.when(F.abs(v) < 1, F.ltrim(digits, F.lit("0"))).otherwise(digits), F.lit("0"))
    e = F.when(shown.contains("E"), F.substring_index(shown, "E", -1).try_cast("int")).otherwise(F.lit(-1))
    small = F.concat(F.lit("."), F.repeat(F.lit("0"), -e - 1), digits)
    whole = F.rpad(digits, F.greatest(e + 1, F.length(digits)), F.lit("0"))
    placed = F.when(e < 0, small).when(F.length(digits) <= e + 1, whole).otherwise(F.concat(F.left(digits, e + 1), F.lit("."), F.substring(digits, e + 2, F.length(digits))))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < INFINITY)
    return F.when(finite & (F.abs(v) < 1) & (F.abs(v) >= 1e-3), F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.lit("."), F.substring_index(shown, ".", -1))).when(
        finite, F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), placed)
    ).otherwise(F.lit(""))


def truthy(c: Column) -> Column:
    """Whether a value's numeric prefix isn't zero."""
    return numprefix(c) != 0


def flag(b: Column) -> Column:
    """A truth as a value."""
    return F.when(b, F.lit("1")).otherwise(F.lit("0"))


def collation(subscript: Column) -> Column:
    """A sort key: the empty string, then numbers by value, then other strings by bytes."""
    numeric = subscript.rlike(SUBSCRIPT)
    rank = F.when(subscript == "", 0).when(numeric, 1).otherwise(2)
    return F.struct(rank.alias("r"), F.when(numeric, subscript.cast("double")).otherwise(F.lit(0.0)).alias("n"), subscript.alias("s"))


def collation_key(subs: Column) -> Column:
    """A sort key of a whole path; a shorter path comes before those that it begins."""
    return F.transform(subs, collation)
