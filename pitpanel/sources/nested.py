"""Nested JSON responses to flat rows: hourly arrays, feature pages, holiday maps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.functions import parsing
from pitpanel.operators.guards import DataGuardError, assert_in_plan

LEAD_DAYS = range(1, 8)


def hourly_rows(responses: DataFrame, *, variable: str, value: str, body: str = "body", points: str = "point_ids") -> DataFrame:
    """(time_utc, point_id, value) from responses with parallel arrays per location.

    A response is one object or an array of them, in the order of its ``point_ids``;
    a different length fails the job.
    """
    hourly = T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField(variable, T.ArrayType(T.StringType())),
    ])
    schema = T.ArrayType(T.StructType([T.StructField("hourly", hourly)]))
    parsed = responses.select(F.from_json(body, schema, {"mode": "FAILFAST"}).alias("_locations"), F.col(points).alias("_ids"))
    matched = parsed.select(
        assert_in_plan(F.col("_locations"), ~F.coalesce(F.size("_locations") == F.size("_ids"), F.lit(False)),
                       "response empty, or locations and points differ in number").alias("_locations"),
        "_ids",
    )
    located = matched.select("_ids", F.posexplode("_locations").alias("_at", "_location"))
    times, values = F.col("_location.hourly.time"), F.col("_location.hourly").getField(variable)
    zipped = assert_in_plan(F.arrays_zip(times.alias("t"), values.alias("v")), F.size(times) != F.size(values),
                            "times and values differ in number")
    hours = located.select(F.get("_ids", F.col("_at")).alias("point_id"), F.explode(zipped).alias("_h")).select(
        F.col("_h.t").try_cast("timestamp_ntz").alias("time_utc"), "point_id", parsing.number("_h.v").alias(value)
    )
    return hours.withColumn("time_utc", assert_in_plan(F.col("time_utc"), F.col("time_utc").isNull(), "unreadable time"))


def forecast_temperature(responses: DataFrame, *, lead_days: int, start: dt.date, end: dt.date, archive_start: dt.date,
                         value: str = "temp_c_forecast") -> DataFrame:
    """Archived forecasts at a fixed lead.  Before the archive begins there are none, and none are made up."""
    if lead_days not in LEAD_DAYS:
        raise DataGuardError("lead_days must lie in 1..7")
    if start < archive_start:
        raise DataGuardError(f"forecast archive starts {archive_start}; shorten the window instead of back-filling")
    rows = hourly_rows(responses, variable=f"temperature_2m_previous_day{lead_days}", value=value)
    return _between(rows, start, end)


def realised_temperature(responses: DataFrame, *, start: dt.date, end: dt.date, value: str = "temp_c_realised") -> DataFrame:
    return _between(hourly_rows(responses, variable="temperature_2m", value=value), start, end)


def _between(rows: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return rows.filter(F.col("time_utc").cast("date").between(F.lit(start), F.lit(end)))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Whole landed responses as text, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("body"), F.input_file_name().alias("file"))


def feature_rows(pages: DataFrame, attributes: Sequence[str], *, body: str = "body") -> DataFrame:
    """Attributes plus longitude/latitude from pages of map features."""
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("attributes", T.StructType([T.StructField(a, T.StringType()) for a in attributes])),
        T.StructField("geometry", T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])),
    ])))])
    parsed = pages.select(F.explode(F.from_json(body, schema, {"mode": "FAILFAST"})["features"]).alias("f"))
    return parsed.select(*[F.col(f"f.attributes.{a}").alias(a) for a in attributes],
                         F.col("f.geometry.x").alias("longitude"), F.col("f.geometry.y").alias("latitude"))


def holiday_rows(bodies: DataFrame, divisions: Sequence[str], *, body: str = "body") -> DataFrame:
    """(date, division, title) from a map of divisions to event lists; a lacking division or unreadable date fails the job."""
    event = T.StructType([T.StructField("title", T.StringType()), T.StructField("date", T.StringType())])
    schema = T.MapType(T.StringType(), T.StructType([T.StructField("events", T.ArrayType(event))]))
    parsed = bodies.select(F.from_json(body, schema, {"mode": "FAILFAST"}).alias("_map"))
    complete = F.coalesce(F.size(F.array_except(F.array(*map(F.lit, divisions)), F.map_keys("_map"))) == 0, F.lit(False))
    entries = parsed.select(F.explode(assert_in_plan(F.col("_map"), ~complete, "a division is absent")).alias("division", "entry"))
    found = entries.filter(F.col("division").isin(*divisions)).select("division", F.inline("entry.events")).select(
        parsing.parse_date("date", ["yyyy-MM-dd"]).alias("date"), "division", "title"
    )
    return found.withColumn("date", assert_in_plan(F.col("date"), F.col("date").isNull(), "unreadable holiday date"))


def response_points(bodies: DataFrame, points_by_file: Mapping[str, Sequence[str]]) -> DataFrame:
    """Attach the ordered point list of each landed file, by file name."""
    pairs = [v for name, ids in points_by_file.items() for v in (F.lit(name), F.array(*[F.lit(p) for p in ids]))]
    name = F.element_at(F.split(F.col("file"), "/"), -1)
    return bodies.withColumn("point_ids", F.create_map(*pairs)[name])
