"""Checks of routines as tables of lines (routine, line_no, text): unused variables, unreachable code, undefined labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABEL = r"^([%A-Za-z][A-Za-z0-9]*)"
_SET = r"(?i)(?:^|[\s.])S(?:ET)?\s+([%A-Za-z][A-Za-z0-9]*)"
_CALL = r"(?i)(?:^|[\s.])(?:D|DO|G|GOTO)\s+([%A-Za-z][A-Za-z0-9]*)(?![A-Za-z0-9^(]*\^)"
_BARE_QUIT = r"(?i)^[\s.]*Q(?:UIT)?\s*(?:;.*)?$"


def lines_of(spark: SparkSession, routine: str, source: str) -> DataFrame:
    """A routine's lines; a line that doesn't begin with white space begins with its label."""
    rows = [(routine, n, line) for n, line in enumerate(source.split("\n"), 1)]
    return with_labels(spark.createDataFrame(rows, "routine string, line_no int, text string"))


def with_labels(lines: DataFrame) -> DataFrame:
    return lines.withColumn("label", F.nullif(F.regexp_extract("text", LABEL, 1), F.lit("")))


def _code(lines: DataFrame) -> DataFrame:
    """Lines without comments and texts in quotes."""
    return lines.withColumn("code", F.regexp_replace(F.regexp_replace("text", r'"(?:[^"]|"")*"', '""'), r";.*$", ""))


def _found(lines: DataFrame, code: str, message: str) -> DataFrame:
    return lines.select("routine", "line_no", F.lit(code).alias("code"), F.format_string(message, F.col("name")).alias("message"))


def unused(lines: DataFrame) -> DataFrame:
    """W001: variables that are set and stand on no other line."""
    code = _code(lines)
    sets = code.select("routine", "line_no", F.explode(F.regexp_extract_all("code", F.lit(_SET), F.lit(1))).alias("name"))
    words = code.select("routine", F.col("line_no").alias("other"), F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"([%A-Za-z][A-Za-z0-9]*)"), F.lit(1)))).alias("name"))
    used = sets.join(words, ["routine", "name"]).filter("other <> line_no").select("routine", "name").distinct()
    return _found(sets.join(used, ["routine", "name"], "left_anti").distinct(), "W001", "variable %s is set but not used")


def unreachable(lines: DataFrame) -> DataFrame:
    """W002: lines without a label right behind a bare QUIT."""
    by = Window.partitionBy("routine").orderBy("line_no")
    before = F.lag("text").over(by)
    code = lines.filter(F.trim(F.regexp_replace("text", r";.*$", "")) != "").withColumn("quit", before.rlike(_BARE_QUIT))
    hit = code.filter(F.col("quit") & F.col("label").isNull())
    return _found(hit.withColumn("name", F.trim("text")), "W002", "unreachable: %s")


def undefined(lines: DataFrame) -> DataFrame:
    """W003: labels that are called and stand nowhere in the routine."""
    calls = _code(lines).select("routine", "line_no", F.explode(F.regexp_extract_all("code", F.lit(_CALL), F.lit(1))).alias("name"))
    labels = lines.filter("label is not null").select("routine", F.col("label").alias("name"))
    return _found(calls.join(labels, ["routine", "name"], "left_anti"), "W003", "label %s isn't defined")


def report(lines: DataFrame) -> DataFrame:
    """All findings."""
    return unused(lines).unionByName(unreachable(lines)).unionByName(undefined(lines))


def summary(lines: DataFrame) -> DataFrame:
    return report(lines).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def text_of(lines: DataFrame, label: str, offset: int = 0) -> DataFrame:
    """The source line at a label and an offset."""
    at = lines.filter(F.col("label") == label).select("routine", (F.col("line_no") + offset).alias("line_no"))
    return lines.join(at, ["routine", "line_no"]).select("routine", "line_no", "text")


def last_events(events: DataFrame, order: str, most: int = 10000) -> DataFrame:
    """The last rows of a trace."""
    return events.orderBy(F.desc(order)).limit(most)
