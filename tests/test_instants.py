from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from corvane.operators.instants import instant_us

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*a, tz="Europe/Paris", micro=0):
    zone = timezone.utc if tz == "UTC" else tz if isinstance(tz, timezone) else ZoneInfo(tz)
    return (datetime(*a, micro, tzinfo=zone) - EPOCH) // timedelta(microseconds=1)


def at(hours):
    return timezone(timedelta(hours=hours))


CASES = [
    ("2024-05-01", us(2024, 5, 1, 0, 0, 0)), ("01/02/2024", us(2024, 2, 1, 0, 0, 0)), ("1/2/24", us(2024, 2, 1, 0, 0, 0)), ("20240501", us(2024, 5, 1, 0, 0, 0)),
    (" 12.06.2019 ", us(2019, 6, 12, 0, 0, 0)), ("2024-05-01 10:11:12", us(2024, 5, 1, 10, 11, 12)), ("2024-01-05T10:11:12Z", us(2024, 1, 5, 10, 11, 12, tz="UTC")),
    ("2016-08-16 23:59:07.267703+02", us(2016, 8, 16, 23, 59, 7, tz=at(2), micro=267703)), ("2018-07-18T04:56:42,928", us(2018, 7, 18, 4, 56, 42, micro=928000)),
    ("2012-03-25T03:43+0200", us(2012, 3, 25, 3, 43, 0, tz=at(2))), ("2015-07-17 02:33:54 CEST", us(2015, 7, 17, 2, 33, 54, tz=at(2))), ("2025-10-26 03:14:20 CET", us(2025, 10, 26, 3, 14, 20, tz=at(1))),
    ("20120703T064409Z", us(2012, 7, 3, 6, 44, 9, tz="UTC")), ("1341869767", 1341869767 * 10**6), ("1344194018449", 1344194018449 * 1000),
    ("Fri, 03 Jan 2014 18:07:20 -1000", us(2014, 1, 3, 18, 7, 20, tz=at(-10))), ("01/01/25 13h47", us(2025, 1, 1, 13, 47, 0)), ("31-12-2020 09:13:38", us(2020, 12, 31, 9, 13, 38)),
    ("01/02/2017 23:19:14 +01:00", us(2017, 2, 1, 23, 19, 14, tz=at(1))), ("1er mai 2017 à 9h02", us(2017, 5, 1, 9, 2, 0)), ("Dimanche 12 JANVIER 2020", us(2020, 1, 12, 0, 0, 0)),
    ("2 août 2012", us(2012, 8, 2, 0, 0, 0)), ("2012-11-12T13:13:15 Indian/Reunion", us(2012, 11, 12, 13, 13, 15, tz="Indian/Reunion")),
    ("2012-07-23T02:52:35+03:00[Indian/Mayotte]", us(2012, 7, 23, 2, 52, 35, tz=at(3))),
    # the hour that occurs twice is the earlier one, the one that is skipped moves on by an hour
    ("2024-10-27 02:30:00", us(2024, 10, 27, 0, 30, 0, tz="UTC")), ("2024-03-31 02:30:00", us(2024, 3, 31, 1, 30, 0, tz="UTC")),
    ("29/02/2024", us(2024, 2, 29, 0, 0, 0)), ("29/02/2000", us(2000, 2, 29, 0, 0, 0)),
    ("29/02/2023 10:00", None), ("2100-02-29", None), ("0000-00-00", None), ("99/99/9999", None), ("2022-13-05", None), ("2022-01-05 24:00:00", None), ("2022-01-05 10:60:00", None),
    ("2022-01-05 10:10:60", None), ("n.c.", None), ("-", None), ("", None), ("   ", None), (None, None), ("12 floréal 2020", None), ("2024-05-01T10:00:00 Nowhere/City", None),
    ("x" * 100_000, None), ("2024-05-01" * 1000, None),
]


@pytest.mark.parametrize("session", ["UTC", "America/New_York"])
def test_cases(spark, session):
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
        got = {r["i"]: r["u"] for r in df.select("i", instant_us(F.col("t")).alias("u")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {CASES[i][0]: u for i, u in got.items()} == dict(CASES)


def test_days_against_the_calendar(spark):
    days = [datetime(1, 1, 1) + timedelta(days=k * 997) for k in range(3600)]
    df = spark.createDataFrame([(d.strftime("%Y").zfill(4) + d.strftime("-%m-%dT00:00:00Z"), (d - datetime(1970, 1, 1)) // timedelta(microseconds=1)) for d in days], "t string, want bigint")
    assert df.where(~instant_us(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_empty(spark):
    assert spark.createDataFrame([], "t string").select(instant_us(F.col("t")).alias("u")).count() == 0
