"""Weighted grids and weighted means over them, and daily degree days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.weather import DEFAULT_BASE_C, degree_deficit
from pitpanel.operators.guards import DataGuardError, require_columns

DEFAULT_LAT_STEP = 0.75
DEFAULT_LON_STEP = 1.5


def coverage_cut(cells: DataFrame, *, size: str, tie_break: Sequence[str], coverage: float,
                 share: str = "_running_share") -> DataFrame:
    """Largest cells up to and including the first that crosses ``coverage``.

    Runs on aggregated cells: the one ordered window sees one row per cell of a
    fixed grid (at most (180/lat step) x (360/lon step)), never the points.
    """
    if not 0.0 < coverage <= 1.0:
        raise DataGuardError("coverage must lie in (0, 1]")
    ranked = Window.orderBy(F.col(size).desc(), *tie_break)
    running = F.sum(size).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(size).over(Window.partitionBy())
    before = F.lag(share).over(ranked)
    return (
        cells.withColumn(share, running / total)
        .withColumn("_before", F.coalesce(before, F.lit(0.0)))
        .filter(F.col("_before") <= coverage)
        .drop("_before")
    )


def grid_weights(points: DataFrame, *, lat: str = "latitude", lon: str = "longitude", mass: str = "population",
                 lat_step: float = DEFAULT_LAT_STEP, lon_step: float = DEFAULT_LON_STEP,
                 coverage: float = 0.995) -> DataFrame:
    """Bin points to a grid; one row per kept cell with its weighted centre and weight (sum 1)."""
    require_columns(points, [lat, lon, mass])
    if not 0.0 < coverage <= 1.0:
        raise DataGuardError("coverage must lie in (0, 1]")
    cells = (
        points.filter(F.col(mass) > 0)
        .groupBy(
            F.floor(F.col(lat) / lat_step).alias("_lat_bin"),
            F.floor(F.col(lon) / lon_step).alias("_lon_bin"),
        )
        .agg(
            F.sum(mass).cast("double").alias("population"),
            (F.sum(F.col(lat) * F.col(mass)) / F.sum(mass)).alias("latitude"),
            (F.sum(F.col(lon) * F.col(mass)) / F.sum(mass)).alias("longitude"),
        )
    )
    kept = coverage_cut(cells, size="population", tie_break=["_lat_bin", "_lon_bin"], coverage=coverage)
    return kept.select(
        F.format_string("c%+03d%+03d", "_lat_bin", "_lon_bin").alias("point_id"),
        "latitude",
        "longitude",
        "population",
        (F.col("population") / F.sum("population").over(Window.partitionBy())).alias("weight"),
    )


def weighted_mean(values: DataFrame, weights: DataFrame, *, time: str, cell: str, value: str, weight: str = "weight",
                  output: str | None = None, unique_cells: bool = False) -> DataFrame:
    """Weighted mean per time; a time that lacks a cell fails the job.

    The output keeps the value's name, so an after-the-fact suffix survives.
    ``unique_cells=True`` promises one row per (time, cell) and saves a shuffle.
    """
    output = output or value
    known = weights.select(cell, F.col(weight).alias("_w"),
                           F.count(F.lit(1)).over(Window.partitionBy()).alias("_expected"))
    rows = values.select(time, cell, value).dropna(subset=[value]).join(known, cell)
    product = F.col(value) * F.col("_w")
    if unique_cells:
        parts = rows.groupBy(time).agg(
            F.sum(product).alias("_vw"), F.sum("_w").alias("_sw"),
            F.count(F.lit(1)).alias("_cells"), F.max("_expected").alias("_expected"),
        )
    else:
        parts = (
            rows.groupBy(time, cell)
            .agg(F.sum(product).alias("_vw"), F.sum("_w").alias("_sw"), F.max("_expected").alias("_expected"))
            .groupBy(time)
            .agg(F.sum("_vw").alias("_vw"), F.sum("_sw").alias("_sw"),
                 F.count(F.lit(1)).alias("_cells"), F.max("_expected").alias("_expected"))
        )
    partial = F.concat(F.lit("partial grid at "), F.col(time).cast("string"), F.lit(": "),
                       F.col("_cells").cast("string"), F.lit(" of "), F.col("_expected").cast("string"))
    mean = F.when(F.col("_cells") < F.col("_expected"), F.raise_error(partial)).otherwise(
        F.col("_vw") / F.col("_sw")
    )
    return parts.select(time, mean.alias(output))


def degree_days(hourly: DataFrame, *, time: str, value: str, tz: str, base_c: float = DEFAULT_BASE_C,
                min_hours: int = 20, day: str = "settlement_date") -> DataFrame:
    """Daily degree days from the mean over the local day; short days are dropped.

    The mean is truncated, not the hours averaged after truncation.
    """
    local_day = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(time).cast("timestamp_ntz")).cast("date")
    return (
        hourly.filter(F.col(value).isNotNull())
        .groupBy(local_day.alias(day))
        .agg(F.avg(value).alias("mean_temp_c"), F.count(F.lit(1)).alias("n_hours"))
        .filter(F.col("n_hours") >= min_hours)
        .select(day, "mean_temp_c", degree_deficit("mean_temp_c", base_c=base_c).alias("hdd"), "n_hours")
    )
