"""Dates as "days,seconds": day 0 is 31 December 1840."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import numprefix, text

EPOCH = "1840-12-31"
# Fixed tokens of date formats and what the date formatter calls them.
TOKENS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH": "HH", "12": "hh", "MI": "mm", "SS": "ss", "AM": "a", "nn": "a"}


def horolog(ts: Column) -> Column:
    """A timestamp as days,seconds."""
    days = F.datediff(ts.cast("date"), F.lit(EPOCH).cast("date"))
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.concat(days.cast("string"), F.lit(","), seconds.cast("string"))


def days(h: Column) -> Column:
    return numprefix(F.split_part(text(h), F.lit(","), F.lit(1))).cast("int")


def seconds(h: Column) -> Column:
    return numprefix(F.split_part(text(h), F.lit(","), F.lit(2))).cast("int")


def zdate(h: Column) -> Column:
    """The date as year-month-day."""
    return F.date_format(F.date_add(F.lit(EPOCH).cast("date"), days(h)), "yyyy-MM-dd")


def ztime(h: Column) -> Column:
    """The time as hours:minutes:seconds."""
    s = seconds(h)
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat_ws(":", two(s / 3600), two((s % 3600) / 60), two(s % 60))


def timestamp(h: Column) -> Column:
    """days,seconds as a timestamp."""
    return F.timestamp_seconds(F.unix_timestamp(F.date_add(F.lit(EPOCH).cast("date"), days(h)).cast("timestamp")) + seconds(h))


def zdatetime(h: Column, form: str = "YYYY-MM-DD HH:MI:SS") -> Column:
    """The date and time in a format of TOKENS; other letters stand for themselves."""
    parts = re.split("(" + "|".join(TOKENS) + ")", form)
    pattern = "".join(TOKENS.get(p) or re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", p.replace("'", "''")) for p in parts if p)
    return F.date_format(timestamp(h), pattern)
