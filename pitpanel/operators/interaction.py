"""Does a group's composition explain how an incumbent's error responds to severity?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions import draws
from pitpanel.operators.features import STOCK_FEATURES, interactions, join_without_clashes, standardised
from pitpanel.operators.fixed_effects import two_way_regression

PRIMARY_FEATURE = STOCK_FEATURES[0]
SECONDARY_FEATURES = STOCK_FEATURES[1:]


def interaction_panel(panel: DataFrame, features: DataFrame, *, unit: str, forecast: str, outcome: str,
                      severity_source: str, names: Sequence[str] = STOCK_FEATURES) -> DataFrame:
    """Join features, add the forecast error, cold severity (z over the whole panel) and products."""
    merged = join_without_clashes(panel, features, [unit])
    merged = merged.withColumn("forecast_error", F.col(forecast) - F.col(outcome))
    cold = -F.col(severity_source).cast("double")
    merged = merged.withColumn("cold_severity_z", standardised(merged, cold))
    return interactions(merged, names, severity="cold_severity_z")


def interaction_test(panel: DataFrame, *, feature: str, role: str, mde: float, unit: str, period: str,
                     bootstrap_draws: int = 999, seed: int = draws.SEED, unit_effects: bool = True,
                     period_effects: bool = True, balanced: bool | None = None) -> DataFrame:
    """One estimate row.  Units without the feature leave the regression altogether."""
    regressor = f"{feature}_x_severity"
    fit = two_way_regression(
        panel, outcome="forecast_error", regressors=[regressor], unit=unit, period=period,
        bootstrap_draws=bootstrap_draws, seed=seed, unit_effects=unit_effects, period_effects=period_effects,
        balanced=balanced,
    )
    return fit.select(
        F.lit(feature).alias("feature"), F.lit(role).alias("role"), "estimate", "cluster_se", "t_stat", "wild_p_value",
        "n_obs", "n_clusters", F.col("n_units").alias("n_units_identifying"), F.lit(float(mde)).alias("mde"),
        (F.abs("estimate") >= F.lit(float(mde))).alias("detectable"),
    )


def interaction_tests(panel: DataFrame, *, mde: float, unit: str, period: str, alpha: float = 0.05,
                      primary: str = PRIMARY_FEATURE, secondary: Sequence[str] = SECONDARY_FEATURES,
                      **options) -> DataFrame:
    """Primary test, then the secondary ones with their family-wise threshold."""
    rows = interaction_test(panel, feature=primary, role="primary", mde=mde, unit=unit, period=period, **options)
    for name in secondary:
        rows = rows.unionByName(
            interaction_test(panel, feature=name, role="secondary", mde=mde, unit=unit, period=period, **options)
        )
    return with_threshold(rows, family="role", alpha=alpha)


def with_threshold(estimates: DataFrame, *, family: str | Column = "role", alpha: float = 0.05) -> DataFrame:
    """Bonferroni threshold: alpha over the number of tests in the family."""
    tests = F.count(F.lit(1)).over(Window.partitionBy(family))
    threshold = F.lit(alpha) / F.greatest(tests, F.lit(1))
    return estimates.withColumn("threshold", threshold).withColumn(
        "significant", F.col("wild_p_value") <= F.col("threshold")
    )
