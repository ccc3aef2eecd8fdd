"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs as one space, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    """The stripped text, or null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """True for null and for white space only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def preview(c: Column, most: int = 240) -> Column:
    """The squeezed text, cut to ``most`` characters with an ellipsis where it is longer."""
    t = squeeze(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"(?U)\s+$", ""), F.lit("…")))


def unescape(c: Column) -> Column:
    """The two-character sequences for carriage return, line feed and tab as spaces."""
    return F.regexp_replace(c, r"\\[rnt]", " ")
