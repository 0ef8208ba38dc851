"""Period series from CSV files: forecast beside outcome, and one file per year.

Text first, then typed columns; a date that fits no layout or an unreadable period stops the load.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.functions import parsing, timecal
from pitpanel.operators.guards import assert_in_plan, refuse_rows, require_columns
from pitpanel.operators.pointintime import latest_per_key


def read_text_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Named columns as text; a missing column or a malformed row fails."""
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST", enforceSchema=False)
    return require_columns(raw, columns).select(*columns)


def period_series(raw: DataFrame, *, date: str, period: str, measures: Mapping[str, str], tz: str,
                  formats: Sequence[str] = parsing.DATE_FORMATS, published: str | None = None,
                  published_name: str = "published_at", keep_periods: tuple[int, int] | None = None) -> DataFrame:
    """UTC period ends, typed measures (``measures``: output -> input), one row per instant.

    Where an instant repeats, the latest publication wins, then the larger values, so the
    choice does not depend on file order.
    """
    typed = raw.select(
        F.col(date).alias("_text"),
        parsing.parse_date(date, formats).alias("settlement_date"),
        parsing.whole_number(period).alias("settlement_period"),
        *[parsing.number(column).alias(name) for name, column in measures.items()],
        *([timecal.local_clock_utc(F.col(published).try_cast("timestamp_ntz"), tz).alias(published_name)] if published else []),
    )
    refuse_rows(typed, F.col("settlement_date").isNull(), "_text", "dates match none of the known layouts")
    number = F.col("settlement_period")
    typed = typed.withColumn("settlement_period", assert_in_plan(number, number.isNull(), "unreadable settlement period"))
    if keep_periods:
        typed = typed.filter(F.col("settlement_period").between(*keep_periods))
    typed = typed.drop("_text").withColumn(
        "settlement_datetime", timecal.period_end_utc("settlement_date", "settlement_period", tz)
    )
    instant = F.col("settlement_datetime")
    typed = typed.withColumn("settlement_datetime", assert_in_plan(instant, instant.isNull(), "period outside its day"))
    rest = [c for c in typed.columns if c != "settlement_datetime"]
    order = ([published_name] if published else []) + [c for c in rest if c != published_name]
    return latest_per_key(typed, ["settlement_datetime"], order=order, keep=rest)


def read_forecast_and_outcome(spark: SparkSession, path: str | Sequence[str], *, date: str, period: str,
                              measures: Mapping[str, str], published: str, tz: str,
                              published_name: str = "published_at") -> DataFrame:
    raw = read_text_csv(spark, path, [date, period, *measures.values(), published])
    return period_series(raw, date=date, period=period, measures=measures, tz=tz, published=published,
                         published_name=published_name)


def read_yearly_series(spark: SparkSession, files: Mapping[int, str], years: Sequence[int], *, date: str, period: str,
                       measures: Mapping[str, str], tz: str) -> DataFrame:
    """Union of the years' files, periods 1..50; a year without a file is an error."""
    unknown = [y for y in years if y not in files]
    if unknown:
        raise KeyError(f"no file for year(s) {unknown}")
    columns = [date, period, *measures.values()]
    parts = [read_text_csv(spark, files[y], columns) for y in years]
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part)
    return period_series(raw, date=date, period=period, measures=measures, tz=tz, keep_periods=(1, 50))
