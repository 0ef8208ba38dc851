"""A large yearly register: slim typed extract, pruned scan, latest record per entity."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.operators.guards import require_columns
from pitpanel.operators.pointintime import entity_key, latest_as_of

# Columns used of the building-certificate register.
REGISTER_COLUMNS = (
    "certificate_number", "uprn", "postcode", "local_authority_label", "country", "lodgement_date", "property_type",
    "built_form", "tenure", "construction_age_band", "total_floor_area", "current_energy_efficiency",
    "walls_description", "walls_energy_eff", "main_fuel", "mainheat_description", "mains_gas_flag",
)

# Columns kept after one record per entity is chosen.
STOCK_COLUMNS = (
    "postcode", "country", "current_energy_efficiency", "total_floor_area", "construction_age_band",
    "walls_description", "walls_energy_eff", "main_fuel", "mainheat_description", "mains_gas_flag",
    "property_type", "built_form", "tenure",
)


def register_years(as_of: dt.date, *, first: int, last: int) -> list[int]:
    """Years that can hold records by ``as_of``; later files are never opened."""
    return list(range(first, min(as_of.year, last) + 1))


def read_register_csv(spark: SparkSession, path: str, *, as_of: dt.date,
                      columns: Sequence[str] = REGISTER_COLUMNS, recorded: str = "lodgement_date") -> DataFrame:
    """Wanted columns of a wide CSV, rows recorded by ``as_of``; unreadable dates leave.

    Selecting by name prunes the parser to those columns.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', mode="PERMISSIVE")
    when = F.try_to_timestamp(F.col(recorded), F.lit("yyyy-MM-dd")).cast("date")
    return require_columns(raw, columns).select(*columns).withColumn(recorded, when).filter(F.col(recorded) <= F.lit(as_of))


def extracted_years(spark: SparkSession, target: str) -> set[int]:
    try:
        rows = spark.read.parquet(target).select("cert_year").distinct().collect()
    except AnalysisException:
        return set()
    return {r[0] for r in rows}


def extract_slim(spark: SparkSession, sources: Mapping[int, str], target: str, *, as_of: dt.date, refresh: bool = False,
                 columns: Sequence[str] = REGISTER_COLUMNS) -> list[int]:
    """Write one Parquet partition per year; years already there are skipped, so a rerun resumes.

    Returns the years written.
    """
    wanted = register_years(as_of, first=min(sources), last=max(sources))
    done = set() if refresh else extracted_years(spark, target)
    written = [y for y in wanted if y in sources and y not in done]
    for year in written:
        slim = read_register_csv(spark, sources[year], as_of=as_of, columns=columns)
        slim.write.mode("overwrite").parquet(f"{target}/cert_year={year}")
    return written


def read_slim(spark: SparkSession, target: str, *, as_of: dt.date) -> DataFrame:
    """The extract up to ``as_of``; the year filter prunes partitions, the date filter row groups."""
    return spark.read.parquet(target).filter(
        (F.col("cert_year") <= as_of.year) & (F.col("lodgement_date") <= F.lit(as_of))
    )


def dwellings(slim: DataFrame, *, as_of: dt.date, keep: Sequence[str] = STOCK_COLUMNS) -> DataFrame:
    """Latest certificate per dwelling as of a date: one aggregate, one shuffle."""
    return latest_as_of(slim, key=entity_key("uprn", "certificate_number"), key_name="addr_key", recorded="lodgement_date",
                        record="certificate_number", as_of=as_of, keep=["lodgement_date", *keep])
