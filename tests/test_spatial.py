import datetime as dt

import pytest
from pyspark.errors import PySparkException

from pitpanel.operators import spatial
from pitpanel.operators.guards import DataGuardError, assert_point_in_time

TZ = "Europe/London"


def hourly(spark, start, values):
    rows = [(dt.datetime.fromisoformat(start) + dt.timedelta(hours=k), v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "time_utc timestamp_ntz, temp_c_forecast double")


def days(df, **options):
    out = spatial.degree_days(df, time="time_utc", value="temp_c_forecast", tz=TZ, **options)
    return {r["settlement_date"].isoformat(): r for r in out.collect()}


@pytest.mark.parametrize("base, want", [(15.5, 5.5), (18.0, 8.0), (5.0, 0.0)])
def test_base_is_a_parameter(spark, base, want):
    assert days(hourly(spark, "2024-01-15", [10.0] * 24), base_c=base)["2024-01-15"]["hdd"] == want


def test_mean_is_truncated_not_the_hours(spark):
    row = days(hourly(spark, "2024-01-15", [5.5] * 12 + [25.5] * 12))["2024-01-15"]
    assert row["hdd"] == 0.0 and row["mean_temp_c"] == 15.5


def test_days_are_local_and_short_days_leave(spark):
    assert set(days(hourly(spark, "2024-06-29 23:00", [12.5] * 48))) == {"2024-06-30", "2024-07-01"}
    assert days(hourly(spark, "2024-01-15", [10.0] * 5)) == {}
    spring = days(hourly(spark, "2024-03-31", [10.0] * 23))
    assert spring["2024-03-31"]["n_hours"] == 23


def points(spark, rows):
    return spark.createDataFrame(rows, "latitude double, longitude double, population double")


def test_cells_weights_and_centre(spark):
    # Cells are 0.75 by 1.5 degrees from 0: 60.1 and 60.7 north fall into one, 59.9 into the one below.
    five = points(spark, [(60.1, 10.6, 50.0), (60.7, 11.9, 10.0), (59.9, 10.6, 20.0), (45.1, 7.6, 15.0), (45.7, 8.9, 5.0)])
    weights = sorted(r["weight"] for r in spatial.grid_weights(five, coverage=1.0).collect())
    assert weights == [0.2, 0.2, 0.6]
    one = spatial.grid_weights(points(spark, [(-33.9, 151.0, 7.0), (-33.8, 150.2, 1.0)]), coverage=1.0).collect()
    assert len(one) == 1 and one[0]["longitude"] == pytest.approx(150.9) and one[0]["latitude"] == pytest.approx(-33.8875)


def test_coverage_keeps_the_crossing_cell(spark):
    df = points(spark, [(40.2, 20.1, 640.0), (44.2, 20.1, 320.0), (48.2, 20.1, 40.0), (62.2, 20.1, 0.0)])
    kept = spatial.grid_weights(df, coverage=0.63).collect()
    assert len(kept) == 1 and kept[0]["weight"] == 1.0
    kept = spatial.grid_weights(df, coverage=0.65).collect()
    assert len(kept) == 2 and sum(r["weight"] for r in kept) == pytest.approx(1.0)
    with pytest.raises(DataGuardError):
        spatial.grid_weights(df, coverage=0.0)
    with pytest.raises(DataGuardError, match="population"):
        spatial.grid_weights(df.drop("population"))


@pytest.mark.parametrize("unique", [True, False])
def test_weighted_mean_and_partial_grid(spark, unique):
    weights = spark.createDataFrame([("a", 0.625), ("b", 0.375)], "point_id string, weight double")
    rows = [(dt.datetime(2030, 7, 4, 6), "a", -4.0), (dt.datetime(2030, 7, 4, 6), "b", 12.0)]
    schema = "time_utc timestamp_ntz, point_id string, temp_c_realised double"
    out = spatial.weighted_mean(spark.createDataFrame(rows, schema), weights, time="time_utc", cell="point_id",
                                value="temp_c_realised", unique_cells=unique)
    assert out.columns == ["time_utc", "temp_c_realised"] and out.first()["temp_c_realised"] == 2.0
    with pytest.raises(DataGuardError, match="realised"):
        assert_point_in_time(out.columns)
    broken = spark.createDataFrame([*rows, (dt.datetime(2030, 7, 4, 7), "b", 1.0)], schema)
    with pytest.raises(PySparkException, match="partial grid"):
        spatial.weighted_mean(broken, weights, time="time_utc", cell="point_id", value="temp_c_realised",
                              unique_cells=unique).collect()
