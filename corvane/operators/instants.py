"""Mixed timestamp texts to exact instants.

Every format is one branch of a single regular expression with named groups; one replacement per value
puts all components out at once. Calendar ranges are checked and the instant is built with integer day
arithmetic. All of it is expressions inside the JVM, so a scan needs no shuffle and no Python.

Defined cases
* Null, empty and blank texts, texts of no known form, and forms that name no real day or time
  (30 February, hour 24, second 60) give null.
* Without a zone the time is that of ``zone``; a date alone is its midnight there. A local time that occurs
  twice is the earlier instant; one that is skipped moves on by the length of the gap.
* An offset governs even where a region stands beside it; a region alone is looked up, an unknown one
  gives null.
* Numeric dates not led by a four-digit year put the day first; two-digit years are 20xx.
* Ten digits are seconds, thirteen milliseconds, sixteen microseconds of the epoch.
* Outer blanks and letter case don't matter, a weekday is not checked, digits of a fraction beyond the
  sixth are cut off.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MONTHS = (
    ("janvier", "january", "janv", "jan"),
    ("février", "fevrier", "february", "févr", "fevr", "fév", "fev", "feb"),
    ("mars", "march", "mar"),
    ("avril", "april", "avr", "apr"),
    ("mai", "may"),
    ("juin", "june", "jun"),
    ("juillet", "july", "juil", "jul"),
    ("août", "aout", "august", "aoû", "aou", "aug"),
    ("septembre", "september", "sept", "sep"),
    ("octobre", "october", "oct"),
    ("novembre", "november", "nov"),
    ("décembre", "decembre", "december", "déc", "dec"),
)
DAYS = "lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|lun|mar|mer|jeu|ven|sam|dim|mon|tue|wed|thu|fri|sat|sun"
#: Zone abbreviations and their minutes east of Greenwich.
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "cet": 60, "cest": 120, "wet": 0, "west": 60, "eet": 120, "eest": 180}

_ZONE = r"(?:\s*(?<z{n}>Z|UTC|GMT|UT|CEST|CET|WEST|WET|EEST|EET|[+\-−]\d{2}(?::?\d{2})?))?(?:\s*\[?(?<r{n}>[A-Z]+(?:/[A-Z0-9_+\-]+)+)\]?)?"
_CLOCK = r"(?<h{n}>\d{1,2})\s*[:h]\s*(?<i{n}>\d{2})(?::(?<s{n}>\d{2})(?:[.,](?<f{n}>\d{1,9}))?)?"
_MONTH = "|".join(sorted((w for m in MONTHS for w in m), key=len, reverse=True))
BRANCHES = (
    r"(?<y{n}>\d{4})[-/.](?<m{n}>\d{1,2})[-/.](?<d{n}>\d{1,2})(?:(?:T|\s+)" + _CLOCK + ")?" + _ZONE,
    r"(?<y{n}>\d{4})(?<m{n}>\d{2})(?<d{n}>\d{2})(?:T?(?<h{n}>\d{2})(?<i{n}>\d{2})(?<s{n}>\d{2})(?:[.,](?<f{n}>\d{1,9}))?)?" + _ZONE,
    r"(?<d{n}>\d{1,2})[-/.](?<m{n}>\d{1,2})[-/.](?<y{n}>\d{4}|\d{2})(?:(?:T|,?\s+)(?:à\s+)?" + _CLOCK + ")?" + _ZONE,
    r"(?:(?:" + DAYS + r")\.?,?\s+)?(?:le\s+)?(?<d{n}>\d{1,2})(?:er|st|nd|rd|th)?\s+(?<w{n}>" + _MONTH + r")\.?,?\s+(?<y{n}>\d{4})(?:,?\s+(?:à\s+)?(?<h{n}>\d{1,2})\s*[:h]\s*(?<i{n}>\d{2})?(?::(?<s{n}>\d{2})(?:[.,](?<f{n}>\d{1,9}))?)?)?" + _ZONE,
    r"(?<e{n}>\d{10}|\d{13}|\d{16})",
)
PARTS = "ymdhisfzrwe"


def pattern() -> tuple[str, str]:
    """The alternation of all formats, and the replacement that lays out its components."""
    numbered = [b.replace("{n}", str(k)) for k, b in enumerate(BRANCHES)]
    whole = r"(?iuU)^\s*(?:" + "|".join(f"(?:{b})" for b in numbered) + r")\s*$"
    layout = "\u0001".join("".join(f"${{{p}{k}}}" for k, b in enumerate(numbered) if f"(?<{p}{k}>" in b) for p in PARTS)
    return whole, layout


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def _zones() -> list[str]:
    try:
        return sorted(SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    except Exception:  # a session without a local JVM
        from zoneinfo import available_timezones

        return sorted(available_timezones())


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def instant_us(text: Column, zone: str = "Europe/Paris") -> Column:
    """Microseconds since 1970-01-01 UTC that a text names, or null."""
    whole, layout = pattern()
    # one pass of the expression; a value that doesn't match comes back without separators
    parts = F.split(F.regexp_replace(text, whole, layout), "\u0001")
    places = {n.lower(): n for n in _zones() if "/" in n}
    named = F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in places.items())), F.lit(";"), F.lit("="))  # one literal, folded once

    def numbers(p: Column) -> Column:
        part = {name: F.get(p, F.lit(i)) for i, name in enumerate(PARTS)}
        num = lambda name: part[name].try_cast("bigint")
        word = F.lower(part["w"])
        month = reduce(lambda acc, k: acc.when(word.isin(*MONTHS[k]), k + 1), range(1, 12), F.when(word.isin(*MONTHS[0]), 1))
        z = F.lower(part["z"])
        digits = F.regexp_replace(z, "[^0-9]", "")
        away = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
        known = reduce(lambda acc, kv: acc.when(z == kv[0], kv[1]), list(ABBREVIATIONS.items())[1:], F.when(z == "z", 0))
        region = F.lower(part["r"])
        return F.struct(
            (num("y") + F.when(F.length(part["y"]) == 2, 2000).otherwise(0)).alias("y"),
            F.coalesce(month.cast("bigint"), num("m")).alias("m"),
            num("d").alias("d"),
            *[F.coalesce(num(x), F.lit(0)).alias(x) for x in "his"],
            F.rpad(F.substring(part["f"], 1, 6), 6, "0").try_cast("bigint").alias("f"),
            (z != "").alias("zoned"),
            F.when(z != "", F.coalesce(known, F.when(z.startswith("+"), away).otherwise(-away))).cast("bigint").alias("offset"),
            F.when(region == "", F.lit(zone)).otherwise(F.try_element_at(named, region)).alias("place"),
        )

    def moment(n: Column) -> Column:
        y, m, d = n["y"], n["m"], n["d"]
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        real = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= longest) & n["h"].between(0, 23) & n["i"].between(0, 59) & n["s"].between(0, 59)
        local = F.when(real, (((_days(y, m, d) * 24 + n["h"]) * 60 + n["i"]) * 60 + n["s"]) * 1_000_000 + F.coalesce(n["f"], F.lit(0)))
        return _bind(
            local,
            lambda us: F.when(n["zoned"], F.when(n["offset"].between(-18 * 60, 18 * 60), us - n["offset"] * 60_000_000)).when(
                n["place"].isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), n["place"]))
            ),
        )

    def build(p: Column) -> Column:
        e = F.get(p, F.lit(PARTS.index("e")))
        epoch = e.try_cast("bigint") * F.when(F.length(e) == 10, 1_000_000).when(F.length(e) == 13, 1000).otherwise(1)
        return F.when(F.size(p) != len(PARTS), None).when(e != "", epoch).otherwise(_bind(numbers(p), moment))

    return _bind(parts, build).cast("bigint")
