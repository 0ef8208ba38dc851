"""Holiday membership and calendar labels on a panel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions import timecal


def holiday_dimension(holidays: DataFrame, *, date: str = "date", division: str = "division",
                      flags: Mapping[str, str]) -> DataFrame:
    """One row per holiday date with a flag per division (``flags``: column -> division)."""
    return holidays.groupBy(F.col(date).cast("date").alias("_holiday")).agg(
        *[F.bool_or(F.col(division) == name).alias(column) for column, name in flags.items()]
    )


def holiday_flags(df: DataFrame, holidays: DataFrame, *, day: str, flags: Mapping[str, str],
                  any_flag: str = "is_holiday_any", date: str = "date", division: str = "division") -> DataFrame:
    """Add per-division flags and their union.  The dimension has a row per holiday,
    so the optimizer broadcasts it from its measured size."""
    dimension = holiday_dimension(holidays, date=date, division=division, flags=flags)
    joined = df.join(dimension, F.col(day).cast("date") == F.col("_holiday"), "left").drop("_holiday")
    either = F.lit(False)
    for column in flags:
        joined = joined.withColumn(column, F.coalesce(F.col(column), F.lit(False)))
        either = either | F.col(column)
    return joined.withColumn(any_flag, either)


def unit_holiday(unit: Column, by_unit: Mapping[str, Column], default: Column) -> Column:
    """Holiday flag by the calendar a unit keeps; others use ``default``."""
    flag = default
    for code, column in by_unit.items():
        flag = F.when(unit == F.lit(code), column).otherwise(flag)
    return flag


def label_days(df: DataFrame, *, day: str, is_holiday: str) -> DataFrame:
    """Season, day type and year-end flag."""
    return df.withColumns({
        "season": timecal.season(day),
        "day_type": timecal.day_type(day, is_holiday),
        "is_christmas_period": timecal.year_end_flag(day),
    })
