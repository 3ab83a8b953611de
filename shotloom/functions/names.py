"""Column functions on names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qualified(source: Column, name: Column) -> Column:
    """source-name"""
    return F.concat_ws("-", source, name)


def from_path(path: Column) -> Column:
    """a/b becomes a-b; a path without a slash names no signal."""
    return F.when(F.contains(path, F.lit("/")), F.replace(path, F.lit("/"), F.lit("-")))


def source_of(signal: Column) -> Column:
    return F.substring_index(signal, "-", 1)


def name_of(signal: Column) -> Column:
    return F.regexp_replace(signal, "^[^-]*-", "")


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def last_number(text: Column) -> Column:
    """The last run of digits, as a long; NULL without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\d+)")), F.lit(-1)).try_cast("long")


def shape_text(shape: Column) -> Column:
    """5x100"""
    return F.array_join(F.transform(shape, lambda x: x.cast("string")), "x")


def number(x: Column) -> Column:
    """Bad text becomes missing."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(100.0 * part, whole.cast("double")), 2)
