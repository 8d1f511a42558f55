"""String functions. Places count code points from 1; positions and counts may be Columns or ints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import SUBSCRIPT, numprefix, text, wholenum

Arg = Column | int | str


def _c(x: Arg) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ascii_code(s: Column, pos: Arg = 1) -> Column:
    """The code of the character at pos, -1 beyond the ends."""
    p = _c(pos)
    return F.when((p < 1) | (p > F.length(text(s))), F.lit(-1)).otherwise(F.ascii(F.substring(text(s), p, F.lit(1))))


def char(*codes: Arg) -> Column:
    return F.concat(*[F.char(_c(x)) for x in codes])


def extract(s: Column, i: Arg = 1, j: Arg | None = None) -> Column:
    """Characters i to j; one character without j."""
    t, a = text(s), _c(i)
    b = a if j is None else _c(j)
    start = F.greatest(a, F.lit(1))
    out = F.substring(t, start, F.greatest(F.lit(0), F.least(b, F.length(t)) - start + 1))
    return out if j is not None else F.when(a < 1, F.lit("")).otherwise(out)


def find(s: Column, t: Arg, start: Arg = 1) -> Column:
    """The place behind the first t from start on, else 0; an empty t gives start."""
    what, at = _c(t), F.greatest(_c(start), F.lit(1))
    hit = F.position(what, text(s), at)
    return F.when(what == "", at).when(hit > 0, hit + F.length(what)).otherwise(F.lit(0))


def _fixed(v: Column, decimals: int, comma: bool = False) -> Column:
    """A number with decimals: its exact binary value is rounded, ties to even, as C does; Java's %f rounds its shortest text, halves up."""
    return F.call_function("format_number", v, F.lit(("#,##0" if comma else "0") + ("." + "0" * decimals if decimals > 0 else "")))


def justify(s: Column, width: Arg, decimals: int | None = None, signed: bool = False) -> Column:
    """Right-justified, never cut; with decimals the value's number, rounded, a zero without a minus unless signed."""
    if decimals is None:
        t = text(s)
    else:
        t = _fixed(numprefix(s), decimals)
        t = t if signed else F.regexp_replace(t, "^-(0(\\.0*)?)$", "$1")
    return F.lpad(t, F.greatest(_c(width), F.length(t)), F.lit(" "))


def _pieces(s: Column, d: str) -> Column:
    return F.split(text(s), r"\Q" + d.replace("\\E", "\\E\\\\E\\Q") + r"\E", -1)


def length(s: Column, d: str | None = None) -> Column:
    """Characters, or pieces between d."""
    if d is None:
        return F.length(text(s))
    return F.length(text(s)) + 1 if d == "" else F.size(_pieces(s, d))


def piece(s: Column, d: str, i: Arg = 1, j: Arg | None = None) -> Column:
    """Pieces i to j between d, joined by d again; one piece without j. An empty d leaves s whole."""
    if d == "":
        return text(s)
    a = F.greatest(_c(i), F.lit(1))
    b = _c(i) if j is None else _c(j)
    return F.array_join(F.slice(_pieces(s, d), a, F.greatest(b - a + 1, F.lit(0))), d)


def set_piece(s: Column, d: str, n: int, value: Column) -> Column:
    """s with piece n replaced; pieces that are missing before it are empty."""
    p = F.array_append(_pieces(s, d), F.lit(""))
    n_pieces = F.size(p) - 1

    def at(i: Column) -> Column:
        return F.when(i == n, text(value)).when(i <= n_pieces, F.get(p, i - 1)).otherwise(F.lit(""))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(n), n_pieces)), at), d)


def set_extract(s: Column, i: int, value: Column, j: int | None = None) -> Column:
    """s with characters i to j replaced."""
    t, last = text(s), i if j is None else j
    return F.concat(F.substring(t, F.lit(1), F.lit(max(i - 1, 0))), text(value), F.substring(t, F.lit(max(last, 0) + 1), F.length(t)))


def reverse(s: Column) -> Column:
    return F.reverse(text(s))


def translate(s: Column, old: str, new: str = "") -> Column:
    """Characters of old become those of new at the same place, or go."""
    return F.translate(text(s), old, new)


def fnumber(s: Column, codes: str = "", decimals: int | None = None) -> Column:
    """The value's number with decimals, thousands (,), a plus sign (+), or parentheses for negatives (P)."""
    v = F.coalesce(wholenum(s), F.lit(0.0))
    size = F.abs(v)
    comma = "," if "," in codes else ""
    if decimals is not None and decimals > 0:
        # the parentheses stand for the sign of what is below zero, which a zero with a minus isn't
        body = _fixed(F.when(v < 0, size).otherwise(v) if "P" in codes.upper() else size, decimals, bool(comma))
    else:
        whole, fraction = F.format_string(f"%{comma}.0f", F.floor(size).cast("double")), F.regexp_extract(size.cast("decimal(38,12)").cast("string"), r"\.(\d*?)0*$", 1)
        body = F.concat(whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit("")))
    if "P" in codes.upper():
        return F.when(v < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(body)
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("+" if "+" in codes else "")), body)


def convert(s: Column, to: str) -> Column:
    """ASCII letters in upper (U) or lower (L) case."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text(s), low, up) if to.upper() == "U" else F.translate(text(s), up, low)


def width(s: Column) -> Column:
    """Bytes."""
    return F.octet_length(text(s))


def strip(s: Column, where: str = "*", chars: str = " \t\r\n\x0b\x0c") -> Column:
    """Without the given characters at the start (<), the end (>) or both (*)."""
    f = {"<": F.ltrim, ">": F.rtrim, "*": F.trim}[where]
    return f(text(s), F.lit(chars))


def substr(s: Column, start: int, size: int | None = None) -> Column:
    """size characters from start, all without size; empty beyond the ends."""
    t = text(s)
    return F.lit("") if start < 1 else F.substring(t, F.lit(start), F.length(t) if size is None else F.lit(max(size, 0)))


def qlength(ref: Column) -> Column:
    """How many subscripts a reference such as ^G(1,"a") has."""
    inner = F.regexp_extract(text(ref), r"(?s)\((.*)\)\s*\z", 1)
    return F.when(~F.contains(text(ref), F.lit("(")), F.lit(0)).when(inner == "", F.lit(0)).otherwise(F.size(_subscripts(inner)))


def _subscripts(inner: Column) -> Column:
    return F.regexp_extract_all(inner, F.lit(r'("(?:[^"]|"")*"|[^,]+)(?:,|$)'), F.lit(1))


def qsubscript(ref: Column, n: int) -> Column:
    """A reference's name (0) or its subscript n without quotes; empty if there is none."""
    if n == 0:
        return F.regexp_extract(text(ref), r"^([^(]*)", 1)
    one = F.coalesce(F.get(_subscripts(F.regexp_extract(text(ref), r"(?s)\((.*)\)\s*\z", 1)), F.lit(n - 1)), F.lit(""))
    return F.when(one.startswith('"'), F.regexp_replace(F.regexp_replace(one, r'^"|"$', ""), '""', '"')).otherwise(one)


def reference(name: Column, subs: Column) -> Column:
    """name(sub,...): numbers plain, strings in quotes."""
    shown = F.transform(subs, lambda x: F.when(x.rlike(SUBSCRIPT), x).otherwise(F.concat(F.lit('"'), F.regexp_replace(x, '"', '""'), F.lit('"'))))
    return F.when(F.size(subs) == 0, name).otherwise(F.concat(name, F.lit("("), F.array_join(shown, ","), F.lit(")")))
