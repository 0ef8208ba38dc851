import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.functions import timecal
from pitpanel.operators import features as feat
from pitpanel.operators import folds as fo
from pitpanel.operators import spatial
from pitpanel.plans import half_hourly as hh
from pitpanel.plans import register_test as rt
from pitpanel.plans import zone_day as zd
from tests.test_lookup_features import dwelling_rows

TZ = "Europe/London"
START, DAYS = dt.date(2024, 1, 1), 130
EVALUATION = dt.datetime(2024, 3, 20)
DIVISIONS = {"is_holiday_ew": "england-and-wales", "is_holiday_scotland": "scotland"}


@pytest.fixture(scope="module")
def holidays(spark):
    return spark.createDataFrame(
        [(dt.date(2024, 1, 1), "england-and-wales", "a"), (dt.date(2024, 1, 2), "scotland", "b"),
         (dt.date(2024, 4, 1), "england-and-wales", "c")], "date date, division string, title string")


@pytest.fixture(scope="module")
def hdd(spark):
    weights = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "point_id string, weight double")
    rng = np.random.default_rng(1)
    hours = pd.date_range("2023-12-31 23:00", periods=24 * (DAYS + 1) + 2, freq="h")
    base = 8 + 5 * np.sin(np.arange(len(hours)) / 200) + rng.normal(0, 1, len(hours))

    def long(value, noise, first=0):
        parts = [pd.DataFrame({"time_utc": hours[first:], "point_id": p, value: (base + d + noise * rng.normal(size=len(hours)))[first:]})
                 for p, d in (("a", 0.0), ("b", 2.0))]
        return spark.createDataFrame(pd.concat(parts)).withColumn("time_utc", F.col("time_utc").cast("timestamp_ntz"))

    return hh.degree_day_series(weights, long("temp_c_forecast", 1.0, 24 * 60), long("temp_c_realised", 0.0), tz=TZ)


def test_weather_series_has_both_sides(hdd):
    rows = hdd.orderBy("settlement_date").collect()
    assert rows[0]["hdd_forecast"] is None and rows[-1]["hdd_forecast"] is not None
    assert all(r["hdd_realised"] is not None for r in rows) and rows[0]["settlement_date"] == START


def test_half_hourly_comparison(spark, hdd, holidays):
    days = spark.range(DAYS).select(F.date_add(F.lit(START), F.col("id").cast("int")).alias("settlement_date"))
    periods = days.select("settlement_date", F.explode(F.sequence(F.lit(1), timecal.periods_in_local_day("settlement_date", TZ))).alias("settlement_period"))
    weather = hdd.select("settlement_date", F.col("hdd_realised").alias("_h"))
    level = 20000 + 600 * F.col("_h") + 30 * F.col("settlement_period") - 1500 * (F.weekday("settlement_date") >= 5).cast("int")
    performance = periods.join(weather, "settlement_date").select(
        "settlement_date", "settlement_period", timecal.period_end_utc("settlement_date", "settlement_period", TZ).alias("settlement_datetime"),
        (level + 50 * F.rand(1)).alias("outcome"), (level + 200 * F.randn(2)).alias("forecast"))
    performance = spark.createDataFrame(performance.toPandas(), performance.schema)
    historic = performance.select("settlement_datetime", (F.col("outcome") + 3).alias("nd_mw"), F.col("outcome").alias("tsd_mw"))
    panel = hh.half_hourly_panel(hdd, performance, historic, holidays, divisions=DIVISIONS)
    assert panel.count() == DAYS * 48 - 2
    result = hh.half_hourly_comparison(panel, evaluation_start=EVALUATION, end=dt.date(2024, 5, 5))
    overall = {r["model"]: r for r in result.scores.filter("grouping = 'all'").collect()}
    assert overall["oracle (realised weather)"]["mae"] < overall["baseline"]["mae"] < overall["seasonal naive"]["mae"]
    assert len({r["n"] for r in overall.values()}) == 1 and overall["incumbent"]["n_effective"] > 100
    assert {r["grouping"] for r in result.scores.select("grouping").distinct().collect()} == {"all", "season", "day_type", "season,day_type"}
    rows = result.folds.orderBy("fold").collect()
    assert rows[0]["groups_fitted"] == 48 and rows[0]["test_start"] == EVALUATION
    facts = {name: df.first() for name, df in result.diagnostics.items()}
    assert facts["reconciliation"]["mean_difference"] == pytest.approx(-3) and facts["extent"]["n_rows"] == overall["baseline"]["n"]
    assert facts["dm_baseline"]["statistic"] > 0 and 0 <= facts["dm_baseline"]["p_value"] <= 1
    assert result.panel.filter(F.col("settlement_datetime") < F.lit(EVALUATION)).filter("baseline is not null").count() == 0


@pytest.fixture(scope="module")
def zone_panel(spark, holidays, hdd):
    rng = np.random.default_rng(4)
    keys = pd.MultiIndex.from_product([pd.date_range(START, periods=DAYS), ["A", "B", "C", "S"]], names=["gas_day", "ldz"]).to_frame(index=False)
    cold = 5 + 4 * np.sin(keys.index.to_numpy() // 4 / 20) + rng.normal(0, 1, len(keys))
    level = 30 - 2 * cold + keys.ldz.map({"A": 0, "B": 2, "C": 4, "S": 6})

    def side(**columns):
        df = spark.createDataFrame(keys.assign(**columns))
        return df.withColumn("gas_day", F.col("gas_day").cast("date"))

    stamp = F.col("gas_day").cast("timestamp_ntz")
    first = side(demand_mscm=level + rng.normal(0, 0.2, len(keys)), unit="mscm").withColumn("published_at", stamp)
    final = first.withColumn("demand_mscm", F.col("demand_mscm") + 0.01)
    return zd.attach_national(zd.zone_day_panel(
        first, final, side(ng_forecast_mscm=level + rng.normal(0, 0.5, len(keys))).withColumn("forecast_published_at", stamp),
        side(cwv_forecast=cold + rng.normal(0, 0.3, len(keys))).withColumn("cwv_published_at", stamp), side(cwv_actual_realised=cold),
        holidays, divisions=DIVISIONS, default_flag="is_holiday_ew", unit_flags={"S": "is_holiday_scotland"}), hdd)


def test_zone_calendar_is_the_units_own(zone_panel):
    got = {(r["gas_day"].day, r["ldz"]): r["day_type"] for r in zone_panel.filter("gas_day <= date'2024-01-02'").collect()}
    assert got[1, "A"] == "holiday" and got[1, "S"] == "weekday" and got[2, "S"] == "holiday" and got[2, "A"] == "weekday"
    assert zone_panel.first()["gas_day_utc"].hour == 5 and zone_panel.count() == DAYS * 4


def test_zone_day_comparison(zone_panel):
    result = zd.zone_day_comparison(zone_panel, evaluation_start=EVALUATION.date(), display_factor=460.0)
    overall = {r["model"]: r["mae"] for r in result.scores.filter("grouping = 'all'").collect()}
    # Annual waves cannot be told from the trend on 80 days; without them the fit is good.
    assert overall["baseline without waves"] < 1 < overall["seasonal naive"]
    facts = {name: df.first() for name, df in result.diagnostics.items()}
    assert facts["restatement"]["mean_revision"] == pytest.approx(0.01) and facts["restatement"]["share_equal"] == 0
    assert facts["extent"]["n_units"] == 4 and facts["gap"]["n"] == facts["extent"]["n_rows"]
    assert facts["national_comparison"]["n"] > 0 and facts["national_comparison"]["incumbent_mae"] < 1
    assert result.diagnostics["mae_by_unit"].count() == 4 and result.diagnostics["weather_deciles"].count() == 10
    assert result.scores.filter("grouping = 'ldz'").count() == 20


def test_register_to_test(spark, zone_panel):
    rows = dwelling_rows("QZ7 3KD", 60, 50) + dwelling_rows("X4 8UU", 61, 60, 3) + dwelling_rows("WD3 6GH", 65, 70, 4) + dwelling_rows("YY20 5RT", 2, 10)
    schema = "postcode string, current_energy_efficiency string, total_floor_area string, construction_age_band string, walls_description string, walls_energy_eff string, mains_gas_flag string"
    certs = spark.createDataFrame(rows, schema).withColumns({
        "certificate_number": F.monotonically_increasing_id().cast("string"), "uprn": F.lit(None).cast("string"),
        "lodgement_date": F.lit("2020-01-01").cast("date"), "country": F.lit("E"), "main_fuel": F.lit("gas"),
        "mainheat_description": F.lit("boiler"), "property_type": F.lit("House"), "built_form": F.lit("x"), "tenure": F.lit("y"),
        "total_floor_area": (F.length("postcode") * 10 + F.col("current_energy_efficiency").cast("int")).cast("string"),
    })
    lookup = spark.createDataFrame([("QZ73KD", "QZ7", "A", True), ("X48UU", "X4", "B", True), ("WD36GH", "WD3", "C", True), ("YY205RT", "YY20", "S", True)],
                                   "postcode string, outcode string, ldz string, is_nts boolean")
    expected = spark.createDataFrame([(z,) for z in "ABCS"], "ldz string")
    features, levels = rt.zone_features(certs, lookup, as_of=dt.date(2023, 11, 30), expected=expected, min_dwellings=50)
    assert levels.first()["match_level"] == "full" and levels.first()["n"] == 188
    assert features.filter("mean_sap_z is null").first()["ldz"] == "S"
    result = rt.register_test(zone_panel, features, levels, mde=0.1, replications=5, bootstrap_draws=19)
    tests = result.tests.collect()
    assert len(tests) == 6 and {r["n_clusters"] for r in tests} == {3} and {r["n_obs"] for r in tests} == {3 * DAYS}
    assert {r["role"]: r["threshold"] for r in tests} == {"primary": 0.05, "secondary": 0.01}
    placebo = result.placebo.collect()
    assert len(placebo) == 5 and {r["n_clusters"] for r in placebo} == {4}
    assert result.sensitivities.count() == 2
