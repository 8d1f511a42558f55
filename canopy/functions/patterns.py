"""Pattern match: a pattern becomes a regular expression with possessive counts, so that nothing is tried twice."""

from __future__ import annotations

import re

from pyspark.sql import Column

from .values import flag, text

# Fixed character classes of the pattern codes.
CLASSES = {"A": "A-Za-z", "N": "0-9", "U": "A-Z", "L": "a-z", "P": r"!-/:-@\[-`{-~", "C": r"\x00-\x1f\x7f", "H": "0-9A-Fa-f"}

_ATOM = re.compile(r'(?P<min>\d*)(?P<dot>\.?)(?P<max>\d*)(?:"(?P<literal>(?:[^"]|"")*)"|(?P<codes>[A-Za-z]+))')


def regex(pattern: str) -> str:
    """The expression for a pattern such as 3N1"-".U.

    A count n asks for exactly n, n. for at least n, .m for at most m and n.m for both; several codes are one class.
    """
    out, at = [], 0
    while at < len(pattern):
        m = _ATOM.match(pattern, at)
        if not m or m.end() == at:
            raise ValueError(f"not a pattern: {pattern[at:]!r}")
        at = m.end()
        if m["literal"] is not None:
            one = "(?:" + re.escape(m["literal"].replace('""', '"')) + ")"
        else:
            one = _class(m["codes"].upper())
        low = m["min"] or ("0" if m["dot"] else "1")
        if not m["dot"]:
            out.append(f"{one}{{{low}}}")
        else:
            out.append(f"{one}{{{low},{m['max']}}}+")
    return r"(?s)\A" + "".join(out) + r"\z"


def _class(codes: str) -> str:
    if "E" in codes:
        return "."
    inside = "".join(CLASSES.get(c, "") for c in codes)
    return f"[{inside}]" if inside else r"(?!)"


def matches(c: Column, pattern: str) -> Column:
    return flag(text(c).rlike(regex(pattern)))


def not_matches(c: Column, pattern: str) -> Column:
    return flag(~text(c).rlike(regex(pattern)))
