"""Register to zone features to the interaction test: placebo first, then the estimates."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.functions import draws
from pitpanel.operators import features as feat
from pitpanel.operators import interaction as inter
from pitpanel.operators import lookup as lk
from pitpanel.operators import simulation as sim
from pitpanel.session import cut_lineage
from pitpanel.sources.register import dwellings


@dataclass
class RegisterResult:
    features: DataFrame
    match_levels: DataFrame
    placebo: DataFrame
    tests: DataFrame
    sensitivities: DataFrame


def zone_features(slim: DataFrame, lookup: DataFrame, *, as_of: dt.date, expected: DataFrame, zone: str = "ldz",
                  min_dwellings: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Certificates to standardised zone features, and how dwellings found their zone."""
    assigned = lk.two_tier_lookup(dwellings(slim, as_of=as_of), key="postcode", lookup=lookup, target=zone)
    levels = lk.match_shares(assigned)
    placed = assigned.filter(F.col(zone).isNotNull())
    # A row per zone: stored, because the checks and the z-scores read it several times.
    raw = cut_lineage(feat.stock_features(placed, zone=zone, min_dwellings=min_dwellings))
    feat.require_units(raw, zone, expected)
    return feat.standardise(raw), levels


def register_test(panel: DataFrame, features: DataFrame, levels: DataFrame, *, mde: float, unit: str = "ldz",
                  period: str = "gas_day", forecast: str = "ng_forecast_mscm", outcome: str = "demand_mscm_d1",
                  severity_source: str = "cwv_forecast", replications: int = 200, bootstrap_draws: int = 999,
                  seed: int = draws.SEED) -> RegisterResult:
    """Placebo on all units, then the pre-specified feature, the others, and one-effect sensitivities."""
    merged = inter.interaction_panel(panel, features, unit=unit, forecast=forecast, outcome=outcome,
                                     severity_source=severity_source)
    products = [f"{name}_x_severity" for name in feat.STOCK_FEATURES]
    merged = cut_lineage(merged.select(unit, period, "forecast_error", "cold_severity_z", *products))
    placebo = sim.placebo(merged, outcome="forecast_error", severity="cold_severity_z", unit=unit, period=period, mde=mde,
                          replications=replications, bootstrap_draws=199, seed=seed)
    options = dict(mde=mde, unit=unit, period=period, bootstrap_draws=bootstrap_draws, seed=seed)
    tests = inter.interaction_tests(merged, **options)
    weaker = inter.interaction_test(merged, feature=inter.PRIMARY_FEATURE, role="unit effects only", period_effects=False, **options)
    weaker = weaker.unionByName(
        inter.interaction_test(merged, feature=inter.PRIMARY_FEATURE, role="period effects only", unit_effects=False, **options)
    )
    return RegisterResult(features, levels, placebo, tests, weaker)
