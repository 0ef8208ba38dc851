"""Forecast errors (forecast - actual, positive = runs high) and their break-downs.

All metrics are ratios of sums, so rows are aggregated once to the finest group
and every break-down rolls up those few cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.serial import DEFAULT_MAX_LAG, effective_n, lag_products_of

_SUMS = ("sum_abs", "sum_sq", "sum_err", "sum_ape")


def error(forecast: Column | str, actual: Column | str) -> Column:
    f = F.col(forecast) if isinstance(forecast, str) else forecast
    a = F.col(actual) if isinstance(actual, str) else actual
    return f - a


def error_cells(df: DataFrame, *, actual: str, forecasts: Mapping[str, str], groups: Sequence[str] = ()) -> DataFrame:
    """Additive error sums per (groups, model) on rows where every forecast exists.

    One wide aggregate for all models; the unpivot happens on cells, not on rows.
    """
    groups = list(groups)
    complete = df.dropna(subset=[actual, *forecasts.values()])
    nonzero = F.when(F.col(actual) != 0, F.abs(F.col(actual)))
    aggregates = [F.count(F.lit(1)).alias("n"), F.count(nonzero).alias("n_nonzero")]
    for i, column in enumerate(forecasts.values()):
        e = error(column, actual)
        aggregates += [
            F.sum(F.abs(e)).alias(f"sum_abs_{i}"),
            F.sum(e * e).alias(f"sum_sq_{i}"),
            F.sum(e).alias(f"sum_err_{i}"),
            F.sum(F.abs(e) / nonzero).alias(f"sum_ape_{i}"),
        ]
    wide = complete.groupBy(*groups).agg(*aggregates)
    models = F.array(*[
        F.struct(F.lit(label).alias("model"), *[F.col(f"{s}_{i}").alias(s) for s in _SUMS])
        for i, label in enumerate(forecasts)
    ])
    return wide.select(*groups, "n", "n_nonzero", F.inline(models))


def metric_columns() -> dict[str, Column]:
    """Metrics from (possibly rolled-up) sums; an empty group gives n = 0 and NULLs."""
    n = F.sum("n")
    return {
        "n": F.coalesce(n, F.lit(0)),
        "mae": F.try_divide(F.sum("sum_abs"), n),
        "rmse": F.sqrt(F.try_divide(F.sum("sum_sq"), n)),
        "bias": F.try_divide(F.sum("sum_err"), n),
        "mape_pct": F.try_divide(F.sum("sum_ape") * 100.0, F.sum("n_nonzero")),
    }


def score(df: DataFrame, *, actual: str, forecasts: Mapping[str, str],
          groupings: Sequence[Sequence[str]] = ((),)) -> DataFrame:
    """Every break-down of one scored table in one pass.

    ``grouping`` names the break-down of a row ("all" for none), so a NULL group
    value is told from a subtotal.
    """
    groups = list(dict.fromkeys(g for s in groupings for g in s))
    cells = error_cells(df, actual=actual, forecasts=forecasts, groups=groups)
    metrics = [expr.alias(name) for name, expr in metric_columns().items()]
    if not groups:
        return cells.groupBy("model").agg(*metrics).select(F.lit("all").alias("grouping"), "model", *metric_columns())
    text = cells.withColumns({g: F.col(g).cast("string") for g in groups})
    sets = [[*s, "model"] for s in groupings]
    kept = [F.when(F.grouping(g) == 0, F.lit(g)) for g in groups]
    label = F.coalesce(F.nullif(F.concat_ws(",", *kept), F.lit("")), F.lit("all"))
    rolled = text.groupingSets(sets, *groups, "model").agg(label.alias("grouping"), *metrics)
    return rolled.select("grouping", *groups, "model", *metric_columns())


def score_with_effective_n(df: DataFrame, *, actual: str, forecasts: Mapping[str, str],
                           groupings: Sequence[Sequence[str]] = ((),), order: Sequence[str],
                           series: Sequence[str] = (), max_lag: int = DEFAULT_MAX_LAG) -> DataFrame:
    """Scores plus the effective sample size of each error series.

    ``order`` orders rows within a break-down group, whose lags then run across the
    units inside it.  Name the units in ``series`` to take lags inside each unit
    and add up the units' effective sizes instead.
    """
    scores = score(df, actual=actual, forecasts=forecasts, groupings=groupings)
    complete = df.dropna(subset=[actual, *forecasts.values()])
    errors = {label: error(column, actual) for label, column in forecasts.items()}
    groups = list(dict.fromkeys(g for s in groupings for g in s))
    parts = []
    for s in groupings:
        keys = [*s, *[c for c in series if c not in s]]
        sizes = effective_n(lag_products_of(complete, values=errors, order=order, group=keys, max_lag=max_lag))
        summed = sizes.groupBy(*s, F.col("label").alias("model")).agg(F.sum("n_effective").alias("n_effective"))
        parts.append(summed.select(
            F.lit(",".join(g for g in groups if g in s) or "all").alias("_grouping"),
            *[(F.col(g).cast("string") if g in s else F.lit(None).cast("string")).alias(f"_{g}") for g in groups],
            F.col("model").alias("_model"),
            "n_effective",
        ))
    sizes = reduce(DataFrame.unionByName, parts)
    on = (F.col("grouping") == F.col("_grouping")) & (F.col("model") == F.col("_model"))
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return scores.join(sizes, on, "left").select(*scores.columns, "n_effective")


def skill(reference: Column | str, candidate: Column | str) -> Column:
    """Percent improvement of the candidate's metric over the reference's; NULL at zero."""
    r = F.col(reference) if isinstance(reference, str) else reference
    c = F.col(candidate) if isinstance(candidate, str) else candidate
    return F.try_divide((r - c) * 100.0, r)


def skill_table(scores: DataFrame, *, reference: str, keys: Sequence[str], metric: str = "mae") -> DataFrame:
    """Skill of every model against one reference model within the same keys."""
    base = scores.filter(F.col("model") == reference).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col(metric).alias("_reference")
    )
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return scores.join(base, on, "inner").withColumn("skill_pct", skill("_reference", metric)).select(
        *keys, "model", metric, "skill_pct"
    )


def mae_by(df: DataFrame, by: Sequence[str], *, actual: str, forecasts: Mapping[str, str]) -> DataFrame:
    """MAE per group and model, long."""
    cells = error_cells(df, actual=actual, forecasts=forecasts, groups=by)
    return cells.groupBy(*by, "model").agg(F.try_divide(F.sum("sum_abs"), F.sum("n")).alias("mae"))


def models_as_columns(scores: DataFrame, *, by: Sequence[str], models: Sequence[str], metric: str = "mae") -> DataFrame:
    """One column per model; the list is given, so no extra pass looks for it."""
    return scores.groupBy(*by).pivot("model", list(models)).agg(F.first(metric))


def daily_error(df: DataFrame, *, day: str, error_column: str, covariate: str, covariate_by: str = "mean",
                instant: str | None = None) -> DataFrame:
    """Mean error per day beside the day's covariate: its mean, or its earliest value."""
    if covariate_by == "mean":
        level = F.avg(covariate)
    else:
        level = F.min_by(F.col(covariate), F.col(instant))
    return df.groupBy(day).agg(F.avg(error_column).alias("mean_error"), level.alias("covariate"))


def quantile_bins(daily: DataFrame, value: str, *, bins: int = 10, output: str = "bin") -> DataFrame:
    """Right-closed bins between interpolated quantiles of ``value``, numbered from 0.

    Meant for one row per day: the exact percentile keeps that column in one buffer.
    """
    probabilities = [k / bins for k in range(1, bins)]
    edges = daily.agg(F.percentile(value, F.array(*[F.lit(p) for p in probabilities]))).scalar()
    above = sum((F.col(value) > F.get(edges, F.lit(k))).cast("int") for k in range(len(probabilities)))
    return daily.withColumn(output, F.when(F.col(value).isNotNull(), above))


def mae_by_bin(daily: DataFrame, *, value: str, error_column: str, bins: int = 10) -> DataFrame:
    return (
        quantile_bins(daily, value, bins=bins)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n_days"), F.avg(F.abs(F.col(error_column))).alias("mae"))
    )


def low_tail_block(daily: DataFrame, *, value: str, error_column: str, probability: float = 0.10) -> DataFrame:
    """Error over the days at or below a quantile, beside all days."""
    cut = daily.agg(F.percentile(value, F.lit(probability))).scalar()
    low = F.col(value) <= cut
    size = F.abs(F.col(error_column))
    return daily.agg(
        F.count(F.when(low, F.lit(1))).alias("n_days"),
        F.avg(F.when(low, size)).alias("mae"),
        F.avg(F.when(low, F.col(error_column))).alias("mean_error"),
        F.avg(size).alias("all_days_mae"),
    )


def reconcile(df: DataFrame, *, a: str, b: str, unit: float = 1.0) -> DataFrame:
    """How far two published views of one quantity differ."""
    pair = df.dropna(subset=[a, b])
    d = F.col(a) - F.col(b)
    return pair.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("mean_difference"),
        F.avg(F.abs(d)).alias("mean_abs_difference"),
        F.avg((F.abs(d) <= unit).cast("double")).alias("share_within_unit"),
        F.max(F.abs(d)).alias("max_abs_difference"),
    )


def gap_decomposition(df: DataFrame, *, actual: str, incumbent: str, baseline: str, perfect_input: str) -> DataFrame:
    """Where the baseline loses to the incumbent: inputs, and a constant bias."""
    complete = df.dropna(subset=[actual, incumbent, baseline, perfect_input])
    base = error(baseline, actual)
    mean_base = complete.agg(F.avg(base)).scalar()
    sums = complete.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(base)).alias("baseline_mae"),
        F.avg(F.abs(error(incumbent, actual))).alias("incumbent_mae"),
        F.avg(F.abs(error(perfect_input, actual))).alias("perfect_input_mae"),
        F.avg(F.abs(base - mean_base)).alias("_unbiased_mae"),
        F.corr(base, error(incumbent, actual)).alias("error_correlation"),
    )
    gap = F.col("baseline_mae") - F.col("incumbent_mae")
    cost = F.col("baseline_mae") - F.col("perfect_input_mae")
    return sums.select(
        "n",
        "baseline_mae",
        "incumbent_mae",
        "perfect_input_mae",
        gap.alias("gap"),
        cost.alias("input_error_cost"),
        F.try_divide(cost, gap).alias("input_error_share"),
        (F.col("baseline_mae") - F.col("_unbiased_mae")).alias("constant_bias_cost"),
        "error_correlation",
    )


def long_window(df: DataFrame, *, actual: str, forecast: str, day: str) -> DataFrame:
    """One forecast's metrics over its whole history, with first and last day."""
    complete = df.dropna(subset=[actual, forecast])
    cells = error_cells(complete, actual=actual, forecasts={"forecast": forecast}, groups=[day])
    metrics = [expr.alias(name) for name, expr in metric_columns().items()]
    return cells.agg(*metrics, F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def compare_on_common_rows(df: DataFrame, *, actual: str, forecasts: Mapping[str, str], day: str) -> DataFrame:
    """MAE of alternative specifications on the rows all of them cover, one row."""
    complete = df.dropna(subset=[actual, *forecasts.values()])
    return complete.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(day).alias("window_start"),
        *[F.avg(F.abs(error(c, actual))).alias(f"{label}_mae") for label, c in forecasts.items()],
    )


def mean_level(df: DataFrame, *, by: str, value: str, factor: float = 1.0) -> DataFrame:
    """Mean level per unit, and the same in a display unit."""
    return df.groupBy(by).agg(
        F.avg(value).alias("mean_level"), (F.avg(value) * F.lit(factor)).alias("mean_level_display")
    )
