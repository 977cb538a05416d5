"""The dialect's operators and functions as Column builders, all of them JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = {"year": (1, 4, 0), "month": (6, 2, 0), "day": (9, 2, 0), "dayofmonth": (9, 2, 0), "hour": (12, 2, 13), "minute": (15, 2, 16), "second": (18, 2, 19)}
PRECISIONS = {"year": (4, "-01-01 00:00:00"), "month": (7, "-01 00:00:00"), "day": (10, " 00:00:00"), "hour": (13, ":00:00"), "minute": (16, ":00"), "second": (19, "")}


def long(c: Column) -> Column:
    return c.cast("bigint")


def int_divide(a: Column, b: Column) -> Column:
    """Truncates towards zero; null where b is 0."""
    return F.call_function("div", long(a), F.nullif(long(b), F.lit(0).cast("bigint")))


def divide(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def remainder(a: Column, b: Column, kind: str) -> Column:
    """Takes the dividend's sign; null where b is 0."""
    return a.cast(kind) % F.nullif(b.cast(kind), F.lit(0).cast(kind))


def like(value: Column, pattern: Column | str) -> Column:
    """% and _ alone are special; a backslash is itself."""
    if isinstance(pattern, str):
        return value.like(pattern.replace("\\", "\\\\"))
    return F.like(value, F.replace(pattern, F.lit("\\"), F.lit("\\\\")))


def java_replacement(text: str) -> str:
    r"""A replacement with groups as \0 to \9 and \\ for a backslash, as the JVM's regular expressions take it."""

    def one(m: re.Match) -> str:
        if m[0] == "$":
            return r"\$"
        if m[0] == "\\":  # the last character
            return r"\\"
        return "$" + m[1] if m[1].isdigit() else r"\\" if m[1] == "\\" else m[1].replace("$", r"\$")

    return re.sub(r"\\(.)|\$|\\", one, text, flags=re.S)


def regexp_replace(value: Column, pattern: Column, replacement: Column | str) -> Column:
    """Replaces every match."""
    if isinstance(replacement, str):
        return F.regexp_replace(value, pattern, F.lit(java_replacement(replacement)))
    # the same translation for a replacement that differs from row to row
    mark = F.lit("\u0000")
    r = F.replace(replacement, F.lit("\\\\"), mark)
    r = F.replace(r, F.lit("$"), F.lit("\\$"))
    r = F.regexp_replace(r, r"\\([0-9])", r"\$$1")
    r = F.regexp_replace(r, r"\\([^0-9$])", "$1")
    return F.regexp_replace(value, pattern, F.replace(r, mark, F.lit("\\\\")))


def extract_text(field: str, c: Column) -> Column:
    """A field of an ISO date or time text by place: null if it is no number, 0 for a time that the text lacks."""
    start, size, least = FIELDS[field]
    part = F.substring(c, start, size)
    number = F.when(part.rlike(r"^[+-]?[0-9]+\z") & (F.length(part) == size), F.expr("1").cast("bigint") * part.try_cast("bigint"))
    return F.when(F.length(c) < least, F.lit(0).cast("bigint")).otherwise(number) if least else number


def extract_time(field: str, c: Column) -> Column:
    return long({"year": F.year, "month": F.month, "day": F.dayofmonth, "dayofmonth": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[field](c))


def trunc_text(precision: str, c: Column) -> Column:
    """Cuts an ISO text and fills it up; texts that are neither a date nor as long as a time are null."""
    keep, rest = PRECISIONS[precision]
    whole = F.when(F.length(c) == 10, F.concat(c, F.lit(" 00:00:00"))).when(F.length(c) >= 19, c)
    return F.concat(F.substring(whole, 1, keep), F.lit(rest))


def trunc_time(precision: str, c: Column) -> Column:
    return F.date_format(F.date_trunc(precision, c), "yyyy-MM-dd HH:mm:ss")


def time_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
