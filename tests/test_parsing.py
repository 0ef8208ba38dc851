import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitpanel.functions import parsing
from pitpanel.functions.weather import degree_deficit
from pitpanel.operators.guards import DataGuardError, refuse_rows


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr).first()[0]


@pytest.mark.parametrize("text, want", [
    ("2024-02-29", dt.date(2024, 2, 29)), (" 05-Jan-2025 ", dt.date(2025, 1, 5)), ("05-Jan-23", dt.date(2023, 1, 5)),
    ("05-Jan-95", dt.date(1995, 1, 5)), ("05/01/2023", None), (None, None),
])
def test_dates_in_known_layouts(spark, text, want):
    assert one(spark, text, parsing.parse_date("v")) == want


def test_unparsed_dates_are_refused_with_examples(spark):
    df = spark.createDataFrame([("2024-01-01",), ("nonsense",)], "v string")
    with pytest.raises(DataGuardError, match="1 dates .*nonsense"):
        refuse_rows(df, parsing.parse_date("v").isNull(), "v", "dates match no layout")


@pytest.mark.parametrize("text, want", [("1.5", 1.5), ("abc", None), ("NaN", None), (None, None), ("1e3", 1000.0)])
def test_numbers(spark, text, want):
    assert one(spark, text, parsing.number("v")) == want


@pytest.mark.parametrize("area, want", [("10", None), ("10.5", 10.5), ("999", 999.0), ("1000", None), ("x", None)])
def test_area_range_is_open(spark, area, want):
    assert one(spark, area, parsing.within(parsing.number("v"), 10, 1000)) == want


@pytest.mark.parametrize("raw, key, coarse", [
    ("qz7 3kd", "QZ73KD", "QZ7"), ("\tX4  8uu\n", "X48UU", "X4"), ("yy20 5rt", "YY205RT", "YY20"), ("w2k", "W2K", None),
])
def test_keys(spark, raw, key, coarse):
    assert one(spark, raw, parsing.normalise_key("v")) == key
    assert one(spark, raw, parsing.outward_key("v")) == coarse


@pytest.mark.parametrize("text, want", [
    ("England and Wales: before 1900", "pre_1930"), ("1900-1929", "pre_1930"), ("1930-1949", "1930_1975"),
    ("England and Wales: 1967-1975", "1930_1975"), ("1976-1982", "1976_1995"), ("2007 onwards", "post_1996"),
    ("unknown", None), (None, None),
])
def test_age_bands(spark, text, want):
    assert one(spark, text, parsing.age_band("v")) == want


@pytest.mark.parametrize("text, kind, insulated", [
    ("Cavity wall, filled cavity", "cavity", True),
    ("Solid brick, as built, no insulation (assumed)", "solid", False),
    ("Timber frame, with internal insulation", "other", True),
    ("Cavity wall beside solid brick", "cavity", None),
    ("System built, as built, insulated (assumed)", "other", False),
    ("Average thermal transmittance", None, None),
])
def test_walls(spark, text, kind, insulated):
    assert one(spark, text, parsing.keyword_class("v")) == kind
    assert one(spark, text, parsing.phrase_flag("v")) is insulated


def test_flags_and_codes(spark):
    assert one(spark, "y", parsing.is_yes("v")) is True
    assert one(spark, "Very Poor", parsing.rated_poor("v")) is True
    assert one(spark, "Demand Forecast, LDZ (EA)", parsing.code_in_label("v", ["EA", "SC"])) == "EA"
    assert one(spark, "Weather, LDZ(SC), D-1", parsing.code_in_label("v", ["EA", "SC"])) == "SC"
    assert one(spark, "Demand, LDZ (XX)", parsing.code_in_label("v", ["EA", "SC"])) is None


def test_degree_deficit_keeps_missing(spark):
    assert one(spark, 10.0, degree_deficit("v"), "double") == 5.5
    assert one(spark, 20.0, degree_deficit("v"), "double") == 0.0
    assert one(spark, None, degree_deficit("v"), "double") is None
    assert spark.range(1).select(degree_deficit(F.lit(10.0), base_c=18.0)).first()[0] == 8.0
