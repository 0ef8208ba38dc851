"""Group features as means and shares, standardisation, and interactions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions import parsing
from pitpanel.operators.guards import DataGuardError, require_columns, require_units

#: Names of the feature columns, as results carry them (fixed values).
STOCK_FEATURES = (
    "mean_sap",
    "share_solid_wall",
    "share_wall_eff_poor",
    "share_pre_1930",
    "mean_floor_area",
    "share_mains_gas",
)


def share(condition: Column) -> Column:
    """Mean of a condition; rows where it is unknown leave the denominator."""
    return F.avg(condition.cast("double"))


def group_features(df: DataFrame, *, by: str, measures: Mapping[str, Column], count: str = "n_dwellings",
                   min_count: int = 50_000, covered: str = "has_stock_coverage",
                   prepared: Mapping[str, Column] | None = None) -> DataFrame:
    """All features of a group in one hash aggregate, with a coverage flag.

    ``prepared`` columns are worked out once per row below the aggregate, so that a text
    class used by several measures is matched once.
    """
    rows = df.withColumns(dict(prepared)) if prepared else df
    return (
        rows.groupBy(by)
        .agg(F.count(F.lit(1)).alias(count), *[expr.alias(name) for name, expr in measures.items()])
        .withColumn(covered, F.col(count) >= min_count)
    )


def stock_columns() -> dict[str, Column]:
    """Typed columns from the building register's text columns."""
    return {
        "_sap": parsing.number("current_energy_efficiency"),
        "_area": parsing.within(parsing.number("total_floor_area"), 10, 1000),
        "_gas": parsing.is_yes("mains_gas_flag"),
        "_wall": parsing.keyword_class("walls_description"),
        "_insulated": parsing.phrase_flag("walls_description"),
        "_poor": parsing.rated_poor("walls_energy_eff"),
        "_band": parsing.age_band("construction_age_band"),
    }


def stock_measures() -> dict[str, Column]:
    """Building features as aggregates over ``stock_columns``."""
    wall, band = F.col("_wall"), F.col("_band")
    return {
        "mean_sap": F.avg("_sap"),
        "mean_floor_area": F.avg("_area"),
        "share_mains_gas": share(F.col("_gas")),
        "share_solid_wall": share(wall == "solid"),
        "share_cavity_wall": share(wall == "cavity"),
        "share_wall_insulated": share(F.col("_insulated")),
        "share_wall_eff_poor": share(F.col("_poor")),
        "share_pre_1930": share(band == "pre_1930"),
        "share_1930_1975": share(band == "1930_1975"),
        "share_1976_1995": share(band == "1976_1995"),
        "share_post_1996": share(band == "post_1996"),
    }


def stock_features(dwellings: DataFrame, *, zone: str, expected: DataFrame | None = None,
                   min_dwellings: int = 50_000) -> DataFrame:
    """One row per zone; every expected zone must be there."""
    features = group_features(dwellings, by=zone, measures=stock_measures(), min_count=min_dwellings,
                              prepared=stock_columns())
    if expected is not None:
        require_units(features, zone, expected)
    return features


def standardise(features: DataFrame, columns: Sequence[str] = STOCK_FEATURES, *,
                covered: str = "has_stock_coverage", min_groups: int = 3) -> DataFrame:
    """Add ``<column>_z`` from moments over covered groups; uncovered groups stay NULL.

    The moments are one row, read once so that a degenerate feature is refused.
    """
    require_columns(features, [covered, *columns])
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        aggregates += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd")]
    moments = features.filter(F.col(covered)).agg(*aggregates).first()
    if moments["_n"] < min_groups:
        raise DataGuardError(f"only {moments['_n']} covered groups; cannot standardise")
    flat = [c for c in columns if not moments[f"{c}_sd"]]
    if flat:
        raise DataGuardError(f"zero variance over covered groups: {flat}")
    return features.withColumns({
        f"{c}_z": F.when(F.col(covered), (F.col(c) - F.lit(moments[f"{c}_mean"])) / F.lit(moments[f"{c}_sd"]))
        for c in columns
    })


def standardised(df: DataFrame, value: Column) -> Column:
    """z-score over all rows of ``df`` (population sd) as scalar subqueries: no join."""
    return (value - df.agg(F.avg(value)).scalar()) / df.agg(F.stddev_pop(value)).scalar()


def interactions(df: DataFrame, features: Sequence[str], *, severity: str, suffix: str = "_x_severity") -> DataFrame:
    """One ``feature_z x severity`` product per feature."""
    require_columns(df, [f"{name}_z" for name in features])
    return df.withColumns({f"{name}{suffix}": F.col(f"{name}_z") * F.col(severity) for name in features})


def join_without_clashes(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_stock") -> DataFrame:
    """Left join; a right column whose name is taken gets the suffix."""
    taken = set(left.columns)
    renamed = right.select(*[
        F.col(c) if c in keys or c not in taken else F.col(c).alias(c + suffix) for c in right.columns
    ])
    return left.join(renamed, list(keys), "left")
