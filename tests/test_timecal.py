import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pitpanel.functions import timecal

TZ = "Europe/London"


def dates(spark, *days):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "d date")


def test_periods_per_day_follow_the_clock_changes(spark):
    rows = dates(spark, "2024-01-15", "2024-03-31", "2024-10-27").select(timecal.periods_in_local_day("d", TZ)).collect()
    assert [r[0] for r in rows] == [48, 46, 50]


@pytest.mark.parametrize("day, period, end", [
    ("2024-01-15", 1, dt.datetime(2024, 1, 15, 0, 30)),
    ("2024-07-15", 1, dt.datetime(2024, 7, 14, 23, 30)),
    ("2024-03-31", 46, dt.datetime(2024, 3, 31, 23, 0)),
    ("2024-10-27", 50, dt.datetime(2024, 10, 28, 0, 0)),
])
def test_period_end(spark, day, period, end):
    assert dates(spark, day).select(timecal.period_end_utc("d", F.lit(period), TZ)).first()[0] == end


def test_a_year_of_periods_is_gapless(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-31')) d")
    ends = days.select(F.explode(F.sequence(F.lit(1), timecal.periods_in_local_day("d", TZ))).alias("p"), "d").select(
        timecal.period_end_utc("d", "p", TZ).alias("t"))
    row = ends.agg(F.count("t"), F.count_distinct("t"), F.min("t"), F.max("t")).first()
    assert row[0] == row[1] == 366 * 48
    assert row[3] - row[2] == dt.timedelta(minutes=30) * (366 * 48 - 1)


@pytest.mark.parametrize("period", [0, 51])
def test_period_outside_the_day_fails(spark, period):
    with pytest.raises(PySparkException, match="period outside"):
        dates(spark, "2024-01-15").select(timecal.period_end_utc("d", F.lit(period), TZ)).collect()


def test_business_day_opens_at_five(spark):
    stamps = ["2024-01-15 04:59:00", "2024-01-15 05:00:00", "2024-01-15 23:00:00", "2024-01-16 04:59:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(
        timecal.business_day(F.col("s").cast("timestamp_ntz")).alias("d"))
    assert [r[0].day for r in df.collect()] == [14, 15, 15, 15]
    assert df.select(timecal.business_day_start("d")).first()[0] == dt.datetime(2024, 1, 14, 5)


def test_local_clock_ambiguous_and_missing_hours(spark):
    stamps = ["2024-10-27 01:30:00", "2024-03-31 01:30:00", "2024-07-01 09:45:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string")
    got = [r[0] for r in df.select(timecal.local_clock_utc(F.col("s").cast("timestamp_ntz"), TZ)).collect()]
    assert got == [dt.datetime(2024, 10, 27, 0, 30), dt.datetime(2024, 3, 31, 1, 0), dt.datetime(2024, 7, 1, 8, 45)]


def test_calendar_labels(spark):
    df = dates(spark, "2024-12-24", "2025-01-01", "2025-01-02", "2024-06-01", "2024-06-02")
    rows = df.select(timecal.season("d"), timecal.year_end_flag("d"), timecal.day_type("d", F.lit(False))).collect()
    assert [tuple(r) for r in rows] == [
        ("winter", True, "weekday"), ("winter", True, "weekday"), ("winter", False, "weekday"),
        ("summer", False, "saturday"), ("summer", False, "sunday"),
    ]
    assert df.select(timecal.day_type("d", F.lit(True))).first()[0] == "holiday"


def test_results_do_not_depend_on_the_session_zone(spark):
    df = dates(spark, "2024-07-15")
    before = df.select(timecal.period_end_utc("d", F.lit(3), TZ)).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(timecal.period_end_utc("d", F.lit(3), TZ)).first()[0] == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_latest_complete_day():
    assert timecal.latest_complete_day(dt.date(2024, 3, 1)) == dt.date(2024, 2, 28)
