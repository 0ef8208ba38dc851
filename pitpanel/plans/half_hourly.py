"""One half-hourly series: weather index, panel, walk-forward models, comparison."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.timecal import folded_period
from pitpanel.functions.weather import DEFAULT_BASE_C
from pitpanel.operators import calendar as cal
from pitpanel.operators import scoring, serial, spatial
from pitpanel.operators.folds import FoldPlan
from pitpanel.operators.guards import assert_point_in_time, scored_rows, up_to
from pitpanel.operators.models import CalendarModel, walk_forward
from pitpanel.operators.pointintime import seasonal_naive
from pitpanel.session import cut_lineage

SPECIFICATIONS = {
    "incumbent": "forecast",
    "baseline": "baseline",
    "baseline without waves": "baseline_no_waves",
    "seasonal naive": "seasonal_naive",
}
ORACLE = "oracle_realised"


@dataclass
class Comparison:
    """Tables of one comparison; every entry is a DataFrame."""

    panel: DataFrame
    folds: DataFrame
    scores: DataFrame
    diagnostics: dict[str, DataFrame] = field(default_factory=dict)


def degree_day_series(weights: DataFrame, forecast: DataFrame, realised: DataFrame, *, tz: str, base_c: float = DEFAULT_BASE_C,
                      day: str = "settlement_date") -> DataFrame:
    """Realised and forecast degree days side by side; the forecast side begins with its archive."""
    sides = {}
    for name, rows, value in (("forecast", forecast, "temp_c_forecast"), ("realised", realised, "temp_c_realised")):
        series = spatial.weighted_mean(rows, weights, time="time_utc", cell="point_id", value=value)
        daily = spatial.degree_days(series, time="time_utc", value=value, tz=tz, base_c=base_c, day=day)
        sides[name] = daily.select(day, F.col("mean_temp_c").alias(f"mean_temp_c_{name}"), F.col("hdd").alias(f"hdd_{name}"),
                                   F.col("n_hours").alias(f"n_hours_{name}"))
    return sides["realised"].join(sides["forecast"], day, "left")


def half_hourly_panel(hdd: DataFrame, performance: DataFrame, historic: DataFrame, holidays: DataFrame, *,
                      divisions: Mapping[str, str], historic_columns: tuple[str, ...] = ("nd_mw", "tsd_mw")) -> DataFrame:
    """Outcome and published forecast per period, a second view of the outcome, weather and calendar."""
    panel = performance.join(historic.select("settlement_datetime", *historic_columns), "settlement_datetime", "left")
    panel = panel.join(hdd, "settlement_date", "left")
    flagged = cal.holiday_flags(panel, holidays, day="settlement_date", flags=divisions)
    return cal.label_days(flagged, day="settlement_date", is_holiday="is_holiday_any")


def half_hourly_comparison(panel: DataFrame, *, evaluation_start: dt.datetime, end: dt.date, target: str = "outcome",
                           incumbent: str = "forecast", second_view: str | None = "nd_mw", span_months: int = 1,
                           embargo: dt.timedelta = dt.timedelta(days=7)) -> Comparison:
    """Fit per period of day on realised weather, serve forecast weather, score against the incumbent."""
    panel = up_to(panel, "settlement_date", end).withColumn("_period", folded_period("settlement_period"))
    base = dict(target=target, fit_on="hdd_realised", group=["_period"], time="settlement_datetime", day="settlement_date",
                min_rows=10)
    models = {
        "baseline": CalendarModel(**base, serve="hdd_forecast", harmonics=2),
        "baseline_no_waves": CalendarModel(**base, serve="hdd_forecast", harmonics=0),
        ORACLE: CalendarModel(**base, serve="hdd_realised", harmonics=2),
    }
    assert_point_in_time([m.serve for name, m in models.items() if name != ORACLE])
    plan = FoldPlan(initial_train_end=evaluation_start - embargo, span_months=span_months, embargo=embargo)
    predicted, _, audit = walk_forward(panel, models, plan)
    predicted = seasonal_naive(predicted, units=["settlement_period"], time="settlement_datetime", value=target)
    if incumbent != "forecast":
        predicted = predicted.withColumn("forecast", F.col(incumbent))
    # Every table below reads the predictions, so they are stored once.
    predicted = cut_lineage(predicted.drop("_period"))

    columns = {**SPECIFICATIONS, "oracle (realised weather)": ORACLE}
    scored = scored_rows(predicted, time="settlement_datetime", start=evaluation_start, needed=[target, "forecast", "baseline"])
    scores = scoring.score_with_effective_n(
        scored, actual=target, forecasts=columns, groupings=((), ("season",), ("day_type",), ("season", "day_type")),
        order=["settlement_datetime"],
    )
    complete = scored.dropna(subset=list(columns.values()))
    base_error, own_error = scoring.error("baseline", target), scoring.error("forecast", target)
    diagnostics = {
        "extent": complete.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("settlement_date").alias("n_days"),
                               F.corr(base_error, own_error).alias("error_correlation")),
        "dm_baseline": serial.diebold_mariano(complete, error_a=base_error, error_b=own_error, order=["settlement_datetime"]),
        "dm_oracle": serial.diebold_mariano(complete, error_a=scoring.error(ORACLE, target), error_b=own_error,
                                            order=["settlement_datetime"]),
        "long_window": scoring.long_window(predicted, actual=target, forecast="forecast", day="settlement_date"),
        "by_period": scoring.mae_by(scored, ["settlement_period"], actual=target, forecasts=columns),
    }
    if second_view:
        diagnostics["reconciliation"] = scoring.reconcile(predicted, a=target, b=second_view)
    return Comparison(predicted, audit, scores, diagnostics)
