"""Publication records (JSON objects, one folder per series) as typed long rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.functions import parsing
from pitpanel.operators.guards import refuse_rows, require_units
from pitpanel.operators.pointintime import Gate, latest_per_key, require_gated, select_at_gate

# Record fields and clock layouts of the feed.
RECORD = T.StructType([
    T.StructField("applicableFor", T.StringType()),
    T.StructField("itemName", T.StringType()),
    T.StructField("generatedTimeStamp", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("UnitOfMeasure", T.StringType()),
])
DAY_FORMAT = "dd/MM/yyyy"
CLOCK_FORMAT = "dd/MM/yyyy HH:mm:ss"

ACTUAL_VINTAGES = ("d_plus_1", "d_plus_6")
WEATHER_KINDS = ("forecast_d_minus_1", "actual")


def read_publications(spark: SparkSession, root: str, series: str, codes: Sequence[str]) -> DataFrame:
    """All publications of a series; the folder name prunes the scan to it."""
    raw = spark.read.schema(RECORD).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/series={series}")
    return parse_publications(raw, codes)


def parse_publications(raw: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Typed rows; a name without a known code or an unreadable time is an error."""
    rows = raw.select(
        parsing.parse_date("applicableFor", [DAY_FORMAT]).alias("gas_day"),
        parsing.code_in_label("itemName", codes).alias("ldz"),
        parsing.number("value").alias("value"),
        parsing.parse_clock("generatedTimeStamp", CLOCK_FORMAT).alias("generated_at"),
        F.col("UnitOfMeasure").alias("unit"),
        F.col("itemName").alias("item"),
    )
    refuse_rows(rows, F.col("ldz").isNull(), "item", "rows have an unparseable unit code")
    refuse_rows(rows, F.col("gas_day").isNull() | F.col("generated_at").isNull(), "item", "rows have unparseable times")
    return rows


def within_days(rows: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        rows = rows.filter(F.col("gas_day") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("gas_day") <= F.lit(end))
    return rows


def _expected(spark: SparkSession, codes: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in codes], "ldz string")


def read_actuals(spark: SparkSession, root: str, codes: Sequence[str], *, vintage_run: str = "d_plus_1", start=None,
                 end=None) -> DataFrame:
    """Daily outcomes of one vintage, last publication per key, every unit present."""
    if vintage_run not in ACTUAL_VINTAGES:
        raise ValueError(f"vintage_run must be one of {ACTUAL_VINTAGES}, got {vintage_run!r}")
    rows = within_days(read_publications(spark, root, f"demand_actual_{vintage_run}", codes), start, end)
    out = latest_per_key(rows, ["gas_day", "ldz"], order=["generated_at", "value"], keep=["value", "generated_at", "unit"])
    out = out.select("gas_day", "ldz", F.col("value").alias("demand_mscm"), F.col("generated_at").alias("published_at"), "unit")
    return require_units(out, "ldz", _expected(spark, codes))


def read_forecast(spark: SparkSession, root: str, codes: Sequence[str], *, gate: Gate = Gate.LAST_BEFORE_DAY, start=None,
                  end=None, series: str = "demand_forecast", value: str = "ng_forecast_mscm",
                  published: str = "forecast_published_at") -> DataFrame:
    """The gated publication per (day, unit), with the time it came from."""
    rows = within_days(read_publications(spark, root, series, codes), start, end)
    chosen = require_gated(
        select_at_gate(rows, gate=gate, day="gas_day", unit="ldz", published="generated_at", value="value"), gate
    )
    out = chosen.select("gas_day", "ldz", F.col("value").alias(value), F.col("generated_at").alias(published))
    return require_units(out, "ldz", _expected(spark, codes))


def read_weather_index(spark: SparkSession, root: str, codes: Sequence[str], *, kind: str = "forecast_d_minus_1",
                       gate: Gate = Gate.LAST_BEFORE_DAY, start=None, end=None) -> DataFrame:
    """Forecast index behind the gate, or the actual one under a name that says so."""
    if kind not in WEATHER_KINDS:
        raise ValueError(f"kind must be one of {WEATHER_KINDS}, got {kind!r}")
    if kind == "forecast_d_minus_1":
        return read_forecast(spark, root, codes, gate=gate, start=start, end=end, series="cwv_forecast_d_minus_1",
                             value="cwv_forecast", published="cwv_published_at")
    rows = within_days(read_publications(spark, root, "cwv_actual", codes), start, end)
    out = latest_per_key(rows, ["gas_day", "ldz"], order=["generated_at", "value"], keep=["value"])
    out = out.select("gas_day", "ldz", F.col("value").alias("cwv_actual_realised"))
    return require_units(out, "ldz", _expected(spark, codes))
