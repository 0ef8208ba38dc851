"""Zone x day panel: gated forecasts, two outcome vintages, comparison and diagnostics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.timecal import business_day_start
from pitpanel.operators import calendar as cal
from pitpanel.operators import pointintime as pit
from pitpanel.operators import scoring
from pitpanel.operators.folds import FoldPlan
from pitpanel.operators.guards import assert_point_in_time, scored_rows
from pitpanel.operators.models import CalendarModel, walk_forward
from pitpanel.plans.half_hourly import Comparison
from pitpanel.session import cut_lineage

KEYS = ["gas_day", "ldz"]
ORACLE = "oracle_cwv_realised"


def zone_day_panel(first: DataFrame, final: DataFrame, forecast: DataFrame, weather_forecast: DataFrame,
                   weather_actual: DataFrame, holidays: DataFrame, *, divisions: Mapping[str, str],
                   default_flag: str, unit_flags: Mapping[str, str]) -> DataFrame:
    """Join the five sources on (day, unit); each unit keeps its own nation's holidays."""
    panel = first.select(*KEYS, F.col("demand_mscm").alias("demand_mscm_d1"),
                         F.col("published_at").alias("outturn_published_at"), "unit")
    for side in (final.select(*KEYS, F.col("demand_mscm").alias("demand_mscm_d6")), forecast, weather_forecast, weather_actual):
        panel = panel.join(side, KEYS, "left")
    flagged = cal.holiday_flags(panel, holidays, day="gas_day", flags=divisions, any_flag="_any")
    own = cal.unit_holiday(F.col("ldz"), {u: F.col(c) for u, c in unit_flags.items()}, F.col(default_flag))
    local = flagged.withColumn("is_holiday_any", own).drop("_any", *divisions)
    labelled = cal.label_days(local, day="gas_day", is_holiday="is_holiday_any")
    return labelled.withColumn("gas_day_utc", business_day_start("gas_day"))


def attach_national(panel: DataFrame, hdd: DataFrame, *, day: str = "settlement_date") -> DataFrame:
    """The national forecast degree days on every unit row; NULL before their archive begins."""
    national = hdd.select(F.col(day).alias("gas_day"), F.col("hdd_forecast").alias("national_hdd_forecast"))
    return panel.join(national, "gas_day", "left")


def zone_day_comparison(panel: DataFrame, *, evaluation_start: dt.date, display_factor: float = 1.0, span_months: int = 1,
                        embargo: dt.timedelta = dt.timedelta(days=7), national: bool = True,
                        pooled_lags: bool = False) -> Comparison:
    """Per-unit models on the published weather index, scored against the published forecast.

    ``pooled_lags`` orders rows by (day, unit) for the effective sample size, as one pooled
    series; by default lags stay inside a unit.
    """
    target = "demand_mscm_d1"
    base = dict(target=target, group=["ldz"], time="gas_day_utc", day="gas_day", min_rows=30)
    models = {
        "baseline": CalendarModel(**base, fit_on="cwv_forecast", serve="cwv_forecast", harmonics=2),
        "baseline_no_waves": CalendarModel(**base, fit_on="cwv_forecast", serve="cwv_forecast", harmonics=0),
        ORACLE: CalendarModel(**base, fit_on="cwv_forecast", serve="cwv_actual_realised", harmonics=2),
    }
    if national:
        models["baseline_national"] = CalendarModel(**base, fit_on="national_hdd_forecast", serve="national_hdd_forecast",
                                                    harmonics=2)
    assert_point_in_time([m.serve for name, m in models.items() if name != ORACLE])
    opening = dt.datetime.combine(evaluation_start, dt.time())
    plan = FoldPlan(initial_train_end=opening - embargo, span_months=span_months, embargo=embargo)
    predicted, _, audit = walk_forward(panel, models, plan)
    predicted = pit.seasonal_naive(predicted, units=["ldz"], time="gas_day", value=target)
    predicted = cut_lineage(predicted)

    columns = {"incumbent": "ng_forecast_mscm", "baseline": "baseline", "baseline without waves": "baseline_no_waves",
               "seasonal naive": "seasonal_naive", "oracle (realised weather)": ORACLE}
    scored = scored_rows(predicted, time="gas_day", start=evaluation_start, needed=[target, "ng_forecast_mscm", "baseline"])
    groupings = ((), ("ldz",), ("season",), ("day_type",), ("season", "day_type"))
    scores = scoring.score_with_effective_n(
        scored, actual=target, forecasts=columns, groupings=groupings,
        order=["gas_day", "ldz"] if pooled_lags else ["gas_day"], series=[] if pooled_lags else ["ldz"],
    )
    complete = scored.dropna(subset=list(columns.values())).withColumn("incumbent_error", scoring.error("ng_forecast_mscm", target))
    daily = scoring.daily_error(complete, day="gas_day", error_column="incumbent_error", covariate="cwv_forecast").dropna()
    daily = cut_lineage(daily)
    diagnostics = {
        "extent": complete.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct("gas_day").alias("n_days"), F.count_distinct("ldz").alias("n_units"),
            F.avg(target).alias("mean_level"), (F.avg(target) * F.lit(display_factor)).alias("mean_level_display"),
            F.corr("cwv_forecast", "cwv_actual_realised").alias("weather_correlation"),
            F.avg(F.abs(F.col("cwv_forecast") - F.col("cwv_actual_realised"))).alias("weather_mae"),
            F.max("gas_day").alias("evaluation_end"),
        ),
        "gap": scoring.gap_decomposition(complete, actual=target, incumbent="ng_forecast_mscm", baseline="baseline",
                                         perfect_input=ORACLE),
        "error_vs_weather": daily.agg(F.corr("covariate", "mean_error").alias("correlation"), F.count(F.lit(1)).alias("n_days")),
        "coldest_decile": scoring.low_tail_block(daily, value="covariate", error_column="mean_error"),
        "weather_deciles": scoring.mae_by_bin(daily, value="covariate", error_column="mean_error"),
        "restatement": pit.revision_stats(predicted, first=target, final="demand_mscm_d6"),
        "unit_levels": scoring.mean_level(complete, by="ldz", value=target, factor=display_factor),
        "mae_by_unit": scoring.models_as_columns(scores.filter(F.col("grouping") == "ldz"), by=["ldz"], models=list(columns)),
    }
    if national:
        diagnostics["national_comparison"] = scoring.compare_on_common_rows(
            scored, actual=target, day="gas_day",
            forecasts={"baseline": "baseline", "national": "baseline_national", "incumbent": "ng_forecast_mscm"},
        )
    return Comparison(predicted, audit, scores, diagnostics)
