"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import strip


def parse_day(c: Column) -> Column:
    """ISO date, else DD/MM/YYYY, of the whole stripped text; null where it names no real day."""
    t = strip(c)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    french = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "d/M/yyyy"))
    return F.coalesce(iso, french)


def stamp_day(c: Column) -> Column:
    """The day that the first ten characters write as YYYY-MM-DD, or null."""
    head = F.substring(strip(c), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def find_day(c: Column) -> Column:
    """The first DD/MM/YYYY anywhere in a text, or null."""
    return F.try_to_date(F.regexp_extract(c, r"(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy")
