import random
from datetime import datetime, timezone
from email.utils import format_datetime

import pytest
from pyspark.sql import functions as F

from tidings.functions import dates


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s"))).first()[0]


@pytest.mark.parametrize("stamp, day", [
    ("Fri, 03 Jul 2026 23:30:00 -0500", "2026-07-04"),
    ("3 Jul 26 01:02 GMT", "2026-07-03"),
    ("Fri, 3 Jul 2026 23:02:03 EST", "2026-07-04"),
    ("Mon, 15 June 2026 10:00:00 +0000", "2026-06-15"),
    ("Fri, 32 Jul 2026 01:02:03 GMT", None),
    ("2026-05-01T23:30:00-05:00", "2026-05-02"),
    ("2026-05-01T00:30:00.123+02:00", "2026-04-30"),
    ("2026-05-01T23:30:00Z", "2026-05-01"),
    ("2026-05-01", "2026-05-01"),
    ("soon", None), ("", None), (None, None),
])
def test_feed_date_is_the_utc_date(spark, stamp, day):
    assert one(spark, stamp, dates.feed_date) == day


@pytest.mark.parametrize("stamp", [
    "2026-07-03", "2026-07-03T10:11:12", "2026-07-03T10:11", "2026-07-03 10:11:12+05:00",
    "2026-07-03T10:11:12.123456Z", "2026-07", "garbage", "2026-13-01", "2026-02-30",
    "2026-07-03T25:00:00", "", None])
def test_rfc2822_replaces_the_offset(spark, stamp):
    try:
        want = format_datetime(datetime.fromisoformat(stamp).replace(tzinfo=timezone.utc))
    except (ValueError, TypeError):
        want = None
    assert one(spark, stamp, dates.rfc2822) == want


def test_rfc2822_takes_what_the_standard_parser_takes(spark):
    """Whole and broken stamps made of parts, and stamps with a character taken out."""
    rng = random.Random(4)
    days = ["2026-07-03", "20260703", "2026-0703", "202607-03", "2026-W27-5", "2026W275", "2026-W275", "2026W27-5",
            "2026-W27", "2026W27", "2020-W53-7", "2021-W53-1", "2026-W54-1", "2026-W00-1", "2026-W27-0",
            "2026-W27-8", "2027-W01-1", "2026-184", "2024-02-29", "2023-02-29", "0001-01-01", "0000-01-01"]
    clocks = ["", "T10", "T10:11", "T1011", "T10:11:12", "T101112", "T10:1112", "T1011:12", " 10:11:12.5",
              "T10:11:12,123456789", "T101112.25", "T10:11.5", "T25:00", "T10:60", "T10:11:60", "x10:11"]
    zones = ["", "Z", "+05", "+05:30", "-0530", "+05:30:15", "+05:3015", "+053015.5", "z", " +05"]
    stamps = [d + c + z for d in days for c in clocks for z in (zones if c else zones[:1])
              if not ("," in c and " " in z)]      # the parser overlooks a character after many digits
    plain = [d + c for d in days for c in clocks]      # before an offset the parser overlooks stray digits
    for stamp in rng.sample(plain, 300):
        at = rng.randrange(len(stamp))
        stamps.append(stamp[:at] + stamp[at + 1:])
    want = []
    for stamp in stamps:
        try:
            want.append(format_datetime(datetime.fromisoformat(stamp).replace(tzinfo=timezone.utc)))
        except ValueError:
            want.append(None)
    df = spark.createDataFrame(list(enumerate(stamps)), "i int, s string").repartition(4)
    got = [r[0] for r in df.orderBy("i").select(dates.rfc2822(F.col("s"))).collect()]
    assert [x for x in zip(stamps, got, want) if x[1] != x[2]] == []


def test_dates_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, "Fri, 03 Jul 2026 23:30:00 -0500", dates.feed_date) == "2026-07-04"
        assert one(spark, "2026-07-04", dates.feed_date) == "2026-07-04"
        assert one(spark, "2026-07-03T10:11:12", dates.rfc2822) == (
            "Fri, 03 Jul 2026 10:11:12 +0000")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("text, day", [
    ("2026-07-03", "2026-07-03"), ("2026-07-03T10:11:12Z", "2026-07-03"), ("2026-02-30", None),
    ("2026-07", None), ("", None), (None, None)])
def test_iso_date(spark, text, day):
    got = one(spark, text, dates.iso_date)
    assert (got and got.isoformat()) == day


@pytest.mark.parametrize("text, day, rest", [
    ("July 26, 2026\n\nBody", "2026-07-26", "Body"),
    ("jULY 6, 2026 \nBody\n", "2026-07-06", "Body\n"),
    ("February 31, 2026\nBody", "2026-02-31", "Body"),
    ("Smarch 1, 2026\nBody", None, "Body"),
    ("July 26, 2026 Body", None, "July 26, 2026 Body"),
    ("July 26, 2026", None, "July 26, 2026"),
    ("On July 26, 2026\nBody", None, "On July 26, 2026\nBody"),
])
def test_leading_date(spark, text, day, rest):
    assert one(spark, text, dates.leading_date) == day
    assert one(spark, text, dates.drop_leading_date) == rest


@pytest.mark.parametrize("published, first_seen, key, month", [
    ("2026-07-03", "2026-08-01", "2026-07-03", "2026-07"),
    (None, "2026-08-01", "2026-08-01", "2026-08"),
    ("", "2026-08-01", "2026-08-01", "2026-08"),
    ("", "", "", "undated"), (None, None, "", "undated"),
])
def test_sort_key_and_month(spark, published, first_seen, key, month):
    df = spark.createDataFrame([(published, first_seen)], "p string, f string")
    sk = dates.sort_key(F.col("p"), F.col("f"))
    assert tuple(df.select(sk, dates.month_bucket(sk)).first()) == (key, month)


def test_recent_months_cross_the_year(spark):
    months = [(y, m) for y in (2025, 2026) for m in range(1, 13)]
    df = spark.createDataFrame(months, "y int, m int")
    kept = df.where(dates.in_recent_months(F.col("y"), F.col("m"), "2026-02-10", 4)).collect()
    assert sorted(map(tuple, kept)) == [(2025, 11), (2025, 12), (2026, 1), (2026, 2)]


def test_last_day(spark):
    df = spark.createDataFrame([(2024, 2), (2023, 2), (2026, 12)], "y int, m int")
    got = [r[0] for r in df.select(dates.last_day_iso(F.col("y"), F.col("m"))).collect()]
    assert got == ["2024-02-29", "2023-02-28", "2026-12-31"]


@pytest.mark.parametrize(("stamp", "want"), [
    ("2026-07-03T10:11:12 garbage", None), ("20260703", "Fri, 03 Jul 2026 00:00:00 +0000"),
    ("20260703T101112Z", "Fri, 03 Jul 2026 10:11:12 +0000"), ("2026-07", None),
    ("2026-03-08T02:30:00", "Sun, 08 Mar 2026 02:30:00 +0000"), ("2026-02-30", None)])
def test_published_stamps_in_a_zone_with_a_gap(spark, stamp, want):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, stamp, dates.rfc2822) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
