"""Clock and calendar expressions.

UTC instants are ``TIMESTAMP_NTZ`` holding UTC, so results do not depend on the
session time zone.  Local dates are ``DATE``.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25

# Month to meteorological season.
SEASON_MONTHS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _ntz(value: Column | str) -> Column:
    return _col(value).cast("timestamp_ntz")


def local_midnight_utc(day: Column | str, tz: str) -> Column:
    """UTC instant at which the local calendar day ``day`` begins."""
    midnight = _col(day).cast("date").cast("timestamp_ntz")
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), midnight)


def period_end_utc(day: Column | str, period: Column | str, tz: str, *,
                   minutes: int = 30, max_period: int = 50) -> Column:
    """UTC end of the 1-based ``period`` of a local day.

    Counting from local midnight in absolute time makes short and long
    clock-change days come out right.  A period outside the day fails the job.
    """
    number = _col(period).cast("int")
    inside = number.between(1, max_period)
    end = local_midnight_utc(day, tz) + F.make_dt_interval(mins=number * F.lit(minutes))
    return F.when(number.isNull() | inside, end).otherwise(
        F.raise_error(F.concat(F.lit(f"period outside 1..{max_period}: "), number.cast("string")))
    )


def periods_in_local_day(day: Column | str, tz: str, *, minutes: int = 30) -> Column:
    """How many periods a local day holds (46, 48 or 50 for half hours)."""
    start = local_midnight_utc(day, tz)
    stop = local_midnight_utc(F.date_add(_col(day).cast("date"), 1), tz)
    return (F.timestamp_diff("MINUTE", start, stop) / F.lit(minutes)).cast("int")


def to_local(instant: Column | str, tz: str) -> Column:
    """Local wall clock of a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _ntz(instant))


def local_clock_utc(clock: Column | str, tz: str) -> Column:
    """UTC instant of a local wall clock.

    A clock reading that occurs twice is taken on the daylight-saving side; one
    that never occurs moves forward to the change (which falls on a full hour).
    """
    wall = _ntz(clock)
    instant = F.convert_timezone(F.lit(tz), F.lit("UTC"), wall)
    back = F.convert_timezone(F.lit("UTC"), F.lit(tz), instant)
    return F.when(back == wall, instant).otherwise(
        F.date_trunc("hour", instant).cast("timestamp_ntz")
    )


def business_day(instant: Column | str, *, start_hour: int = 5) -> Column:
    """Date of the business day that opens at ``start_hour`` UTC."""
    return (_ntz(instant) - F.make_dt_interval(hours=F.lit(start_hour))).cast("date")


def business_day_start(day: Column | str, *, start_hour: int = 5) -> Column:
    """UTC instant at which a business day opens."""
    return _col(day).cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(start_hour))


def season(day: Column | str) -> Column:
    month = F.month(_col(day))
    label = F.lit(None).cast("string")
    for name, months in SEASON_MONTHS.items():
        label = F.when(month.isin(*months), F.lit(name)).otherwise(label)
    return label


def day_type(day: Column | str, is_holiday: Column | str) -> Column:
    """holiday, else saturday, sunday or weekday."""
    weekday = F.weekday(_col(day))
    return (
        F.when(_col(is_holiday), F.lit("holiday"))
        .when(weekday == 5, F.lit("saturday"))
        .when(weekday == 6, F.lit("sunday"))
        .when(weekday.isNotNull(), F.lit("weekday"))
    )


def year_end_flag(day: Column | str) -> Column:
    """24 December to 1 January."""
    month, number = F.month(_col(day)), F.dayofmonth(_col(day))
    return ((month == 12) & (number >= 24)) | ((month == 1) & (number == 1))


def folded_period(period: Column | str, *, last: int = 48) -> Column:
    """Group id for per-period models: the rare late periods share the last model."""
    return F.when(_col(period).isNotNull(), F.least(_col(period), F.lit(last)))


def latest_complete_day(as_of: dt.date, *, lag_days: int = 2) -> dt.date:
    """Last day whose outcome should be published by ``as_of``."""
    return as_of - dt.timedelta(days=lag_days)


def calendar_terms(day: Column | str, origin: dt.date, *, harmonics: int = 2) -> list[tuple[str, Column]]:
    """Design columns that depend on the date only: weekday dummies, trend, annual waves."""
    date = _col(day).cast("date")
    weekday = F.weekday(date)
    terms = [(f"dow_{k}", (weekday == k).cast("double")) for k in range(1, 7)]
    terms.append(("trend", F.datediff(date, F.lit(origin)) / F.lit(DAYS_PER_YEAR)))
    angle = F.dayofyear(date) * F.lit(2.0 * math.pi) / F.lit(DAYS_PER_YEAR)
    for k in range(1, harmonics + 1):
        terms.append((f"sin_{k}", F.sin(angle * F.lit(float(k)))))
        terms.append((f"cos_{k}", F.cos(angle * F.lit(float(k)))))
    return terms
