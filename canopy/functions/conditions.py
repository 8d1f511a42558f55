"""Conditions, defaults and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import text, truthy


def select(*pairs: tuple[Column, Column]) -> Column:
    """The value of the first true condition, else empty."""
    out = None
    for condition, value in pairs:
        out = F.when(truthy(condition), text(value)) if out is None else out.when(truthy(condition), text(value))
    return F.lit("") if out is None else out.otherwise(F.lit(""))


def case(x: Column, *pairs: tuple[Column | str, Column | str], default: Column | str = "") -> Column:
    """The result for the first equal value, else the default."""
    one = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = text(one(default))
    for value, result in reversed(pairs):
        out = F.when(text(x) == text(one(value)), text(one(result))).otherwise(out)
    return out


def get(c: Column, default: Column | str = "") -> Column:
    """The value unless it is missing or empty, else the default."""
    return F.coalesce(F.nullif(text(c), F.lit("")), default if isinstance(default, Column) else F.lit(default))


def json_parse(c: Column) -> Column:
    """JSON text written again in its plain form; empty if it isn't JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(text(c))), F.lit(""))


def json_stringify(c: Column) -> Column:
    """JSON text in its plain form, else the value as a JSON string."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(text(c), r'(["\\])', r"\\$1"), F.lit('"'))
    return F.coalesce(F.to_json(F.try_parse_json(text(c))), quoted)
