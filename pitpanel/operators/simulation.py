"""Placebo runs, power by whole-cluster resampling, and leave-one-unit-out.

Placebo replications are columns of the panel, some at a time, so that one pass of the
fixed-effects operators serves many and the panel is never copied. Power draws clusters
once and shares the draws over all effects, which enter the cluster sums linearly. The
same path serves every number of units, balanced or not. ``balanced=True`` promises exactly
one row per (unit, period) and saves that check.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions import draws
from pitpanel.operators.features import standardised
from pitpanel.operators.fixed_effects import absorb, bootstrap_p, bootstrap_t, fit_from_blocks
from pitpanel.operators.fixed_effects import infer, is_balanced
from pitpanel.session import cut_lineage

#: Replications that share one pass, and hexadecimal digits of the hash buckets by which units are numbered.
COLUMNS = 25
BUCKET_DIGITS = 3

# Effect sizes of a power curve, as multiples of the residual sd.
EFFECT_MULTIPLES = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.10, 0.15, 0.20, 0.30, 0.50)


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def unit_scores(units: DataFrame, unit: str, *, replications: int, seed: int) -> DataFrame:
    """(replication, unit, score): standard normal by unit, standardised within a replication."""
    raw = units.select(unit).filter(F.col(unit).isNotNull()).distinct().select(
        unit, F.explode(_upto(replications)).alias("replication")
    ).withColumn("_raw", draws.normal(seed, F.col("replication"), F.col(unit)))
    moments = raw.groupBy("replication").agg(F.avg("_raw").alias("_mean"), F.stddev_pop("_raw").alias("_sd"))
    return raw.join(moments, "replication").select(
        "replication", unit, F.try_divide(F.col("_raw") - F.col("_mean"), F.col("_sd")).alias("score")
    )


def simulated_interaction(df: DataFrame, *, unit: str, severity: str, seed: int, output: str = "interaction") -> DataFrame:
    """A random time-invariant unit score times standardised severity."""
    scores = unit_scores(df, unit, replications=1, seed=seed).select(unit, "score")
    return (
        df.withColumn("_severity_z", standardised(df, F.col(severity)))
        .join(scores, unit, "left")
        .withColumn(output, F.col("score") * F.col("_severity_z"))
        .drop("_severity_z")
    )


def _placebo_blocks(usable: DataFrame, *, unit: str, period: str, outcome: str, severity: str, replications: int,
                    seed: int, balanced: bool) -> DataFrame:
    """Cluster rows of every replication: replications are columns of one panel, some at a time.

    The scores of a unit are one array beside its rows, stored once.
    """
    scores = unit_scores(usable, unit, replications=replications, seed=seed).groupBy(unit).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("replication", "score"))), lambda s: s["score"]).alias("_scores"))
    rows, parts = cut_lineage(usable.join(scores, unit)), []
    for at in range(0, replications, COLUMNS):
        names = [f"_x{k}" for k in range(at, min(at + COLUMNS, replications))]
        rows_at = rows.select(unit, period, outcome, *[
            (F.get("_scores", F.lit(int(c[2:]))) * F.col(severity)).alias(c) for c in names])
        within = absorb(rows_at, [outcome, *names], unit=unit, period=period, balanced=balanced)
        y = F.col(f"{outcome}_within")
        sums = within.groupBy(F.col(unit).alias("cluster")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("yy"),
            *[F.sum(e).alias(f"{c}{tag}") for c in names for tag, e in (
                ("s", F.col(f"{c}_within")), ("p", F.col(f"{c}_within") * y), ("q", F.pow(F.col(f"{c}_within"), F.lit(2))))],
        )
        stacked = F.explode(F.array(*[
            F.struct(F.lit(int(c[2:])).cast("bigint").alias("replication"), F.col(f"{c}s").alias("sx_0"),
                     F.col(f"{c}p").alias("xy_0"), F.col(f"{c}q").alias("xx_0_0")) for c in names]))
        parts.append(sums.select("cluster", "n", "sy", "yy", stacked.alias("_r")).select(
            "_r.replication", "cluster", "n", "sy", "yy", "_r.sx_0", "_r.xy_0", "_r.xx_0_0"))
    return reduce(DataFrame.unionByName, parts)


def placebo(df: DataFrame, *, outcome: str, severity: str, unit: str, period: str, mde: float,
            replications: int = 200, bootstrap_draws: int = 199, seed: int = draws.SEED,
            balanced: bool | None = None) -> DataFrame:
    """Random per-unit scores through the interaction test, one row per replication.

    Every unit takes part, covered or not. Eager: one pass over the panel for every ``COLUMNS``
    replications.
    """
    usable = df.dropna(subset=[outcome, severity, unit, period]).select(unit, period, outcome, severity)
    if balanced is None:
        balanced = is_balanced(usable, unit=unit, period=period, single=True)
    blocks = _placebo_blocks(usable, unit=unit, period=period, outcome=outcome, severity=severity,
                             replications=replications, seed=seed, balanced=balanced)
    result = infer(cut_lineage(blocks), ["placebo"], keys=["replication"], bootstrap_draws=bootstrap_draws, seed=seed + 1)
    return result.select(
        "replication", "estimate", "wild_p_value", (F.abs("estimate") / F.lit(mde)).alias("abs_estimate_over_mde"),
        "n_obs", "n_clusters",
    )


def _numbered(units: DataFrame, unit: str) -> DataFrame:
    """(unit, _id from 0, _G): numbers within hash buckets plus the sizes of the buckets before."""
    listed = units.select(unit).distinct().withColumn("_b", F.substring(F.md5(F.col(unit).cast("string")), 1, BUCKET_DIGITS))
    sizes = listed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_from"),
                          F.sum("_n").over(Window.partitionBy()).alias("_G"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(unit)) - 1
    return listed.withColumn("_in", inside).join(before, "_b").select(
        unit, (F.col("_from") + F.col("_in")).cast("bigint").alias("_id"), "_G")


def _assignments(units: DataFrame, unit: str, *, simulations: int, seed: int) -> DataFrame:
    """(simulation, target unit, source unit): clusters drawn with replacement."""
    numbered = cut_lineage(_numbered(units, unit))
    runs = numbered.withColumn("simulation", F.explode(_upto(simulations)))
    source = draws.choice(seed, F.col("_G"), F.col("simulation"), F.col(unit))
    return runs.withColumn("_source", source).join(
        numbered.select(F.col("_id").alias("_source"), F.col(unit).alias("source")), "_source"
    ).select("simulation", F.col(unit).alias("target_unit"), "source")


def _power_blocks(rows: DataFrame, *, unit: str, period: str, grid: Sequence[float], simulations: int, seed: int,
                  balanced: bool) -> DataFrame:
    """Cluster rows per (effect, simulation).

    A simulation gives every unit the residuals of a drawn one, matched by position and repeated
    when the source series is the shorter one. Draws are shared by all effects: an effect adds
    itself times the regressor, so it enters the cluster sums of a simulation linearly, and only
    the drawn (target, source) pairs are ever joined.
    """
    by_unit = Window.partitionBy(unit).orderBy(period)
    placed = rows.withColumn("_pos", F.row_number().over(by_unit) - 1)
    lengths = rows.groupBy(F.col(unit).alias("source")).agg(F.count(F.lit(1)).alias("_len"))
    drawn = _assignments(rows, unit, simulations=simulations, seed=seed).join(lengths, "source")
    source = placed.select(F.col(unit).alias("source"), F.col("_pos").alias("_at"), F.col("r").alias("_r"))
    trial = (
        placed.select(unit, period, "x", "_pos").join(drawn.withColumnRenamed("target_unit", unit), unit)
        .withColumn("_at", F.pmod(F.col("_pos"), F.col("_len")).cast("int"))
        .join(source, ["source", "_at"])
        .select("simulation", unit, period, "x", "_r")
    )
    within = absorb(trial, ["_r"], unit=unit, period=period, keys=["simulation"], balanced=balanced)
    x, y = F.col("x"), F.col("_r_within")
    sums = cut_lineage(within.groupBy("simulation", F.col(unit).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("yy"), F.sum(x).alias("sx_0"),
        F.sum(x * y).alias("xy_0"), F.sum(x * x).alias("xx_0_0")))
    effects = F.array(*[F.lit(float(e)) for e in grid])
    e = F.col("_e")
    return sums.select("*", F.posexplode(effects).alias("effect_id", "_e")).select(
        F.col("effect_id").cast("bigint").alias("effect_id"), "simulation", "cluster", "n",
        (F.col("sy") + e * F.col("sx_0")).alias("sy"),
        (F.col("yy") + 2.0 * e * F.col("xy_0") + e * e * F.col("xx_0_0")).alias("yy"),
        "sx_0", (F.col("xy_0") + e * F.col("xx_0_0")).alias("xy_0"), "xx_0_0")


def power_curve(df: DataFrame, *, outcome: str, unit: str, period: str, severity: str,
                effect_grid: Sequence[float] | None = None, simulations: int = 200, bootstrap_draws: int = 199,
                target_power: float = 0.80, alpha: float = 0.05, seed: int = draws.SEED,
                balanced: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Rejection share per true effect, and the smallest effect that reaches target power.

    Residuals are resampled a whole unit at a time, which keeps their serial
    dependence.  Returns (curve, one-row summary).
    """
    usable = df.dropna(subset=[outcome, unit, period, severity]).select(unit, period, outcome, severity)
    with_x = simulated_interaction(usable, unit=unit, severity=severity, seed=seed, output="raw")
    if balanced is None:
        balanced = is_balanced(usable, unit=unit, period=period, single=True)
    within = absorb(with_x, [outcome, "raw"], unit=unit, period=period, balanced=balanced)
    rows = cut_lineage(within.select(unit, period, F.col(outcome).alias("level"), "raw",
                                     F.col("raw_within").alias("x"), F.col(f"{outcome}_within").alias("r")))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n_obs"), F.count_distinct(unit).alias("n_clusters"),
        F.count_distinct(period).alias("n_periods"), F.stddev_samp("r").alias("residual_sd"),
        F.avg(F.abs("level")).alias("mean_abs_error"), F.stddev_pop("raw").alias("interaction_sd"),
    ).first()
    grid = list(effect_grid) if effect_grid is not None else [m * facts["residual_sd"] for m in EFFECT_MULTIPLES]
    blocks = _power_blocks(rows, unit=unit, period=period, grid=grid, simulations=simulations, seed=seed + 1, balanced=balanced)
    keys = ["effect_id", "simulation"]
    blocks = cut_lineage(blocks)
    fits = fit_from_blocks(blocks, ["interaction"], keys=keys)
    tests = bootstrap_p(fits, bootstrap_t(blocks, 1, keys=keys, count=bootstrap_draws, seed=seed + 2), keys=keys)
    effect = F.get(F.array(*[F.lit(float(e)) for e in grid]), F.col("effect_id").cast("int"))
    curve = tests.groupBy("effect_id").agg(
        F.avg(F.coalesce((F.col("wild_p_value") <= alpha).cast("double"), F.lit(0.0))).alias("power")
    ).select("effect_id", effect.alias("effect"), "power")
    curve = cut_lineage(curve)
    reached = F.min(F.when(F.col("power") >= target_power, F.col("effect")))
    summary = curve.agg(reached.alias("mde"), F.max(F.when(F.col("effect") == 0, F.col("power"))).alias("size_at_zero")).select(
        "mde", F.try_divide(F.col("mde"), F.lit(facts["mean_abs_error"])).alias("mde_share_of_mean_abs_error"), "size_at_zero",
        *[F.lit(facts[c]).alias(c) for c in ("n_obs", "n_clusters", "n_periods", "residual_sd", "mean_abs_error", "interaction_sd")],
        F.lit(target_power).alias("target_power"), F.lit(alpha).alias("alpha"), F.lit(simulations).alias("simulations"),
        F.lit(bootstrap_draws).alias("bootstrap_draws"), F.lit(seed).alias("seed"),
    )
    return curve, summary


def leave_one_unit_out(df: DataFrame, *, outcome: str, regressor: str, unit: str, period: str,
                       balanced: bool | None = None) -> DataFrame:
    """Two-way estimate with each unit dropped in turn, one row per dropped unit.

    On a balanced panel the dropped unit enters through sums over its own rows, so one
    pass serves all; an unbalanced one repeats the panel per dropped unit.
    """
    usable = df.dropna(subset=[outcome, regressor, unit, period]).select(unit, period, outcome, regressor)
    if balanced is None:
        balanced = is_balanced(usable, unit=unit, period=period, single=True)
    if not balanced:
        listed = usable.agg(F.collect_set(unit)).scalar()
        rows = usable.withColumn("left_out", F.explode(F.array_except(listed, F.array(unit))))
        within = absorb(rows, [outcome, regressor], unit=unit, period=period, keys=["left_out"], balanced=False)
        x, y = F.col(f"{regressor}_within"), F.col(f"{outcome}_within")
        return within.groupBy("left_out").agg(F.try_divide(F.sum(x * y), F.sum(x * x)).alias("estimate"))
    means = usable.groupBy(unit).agg(F.avg(outcome).alias("_my"), F.avg(regressor).alias("_mx"))
    rows = usable.join(means, unit).select(
        unit, period, (F.col(regressor) - F.col("_mx")).alias("x"), (F.col(outcome) - F.col("_my")).alias("y")
    )
    sums = rows.groupBy(period).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    x, y, sx, sy = (F.col(c) for c in ("x", "y", "sx", "sy"))
    own = rows.join(sums, period).groupBy(unit).agg(
        F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"),
        F.sum(sx * x).alias("sxx"), F.sum(sx * y + sy * x).alias("sxy"),
    )
    whole = own.agg(F.sum("xx").alias("xx"), F.sum("xy").alias("xy"), F.count(F.lit(1)).alias("g"))
    across = sums.agg(F.sum(sx * sx).alias("xx"), F.sum(sx * sy).alias("xy"))
    kept = whole.select("g").scalar() - F.lit(1)

    def without(product: str, pulled: Column) -> Column:
        return (whole.select(product).scalar() - F.col(product)) - (
            across.select(product).scalar() - pulled + F.col(product)
        ) / kept

    return own.select(
        F.col(unit).alias("left_out"),
        F.try_divide(without("xy", F.col("sxy")), without("xx", 2.0 * F.col("sxx"))).alias("estimate"),
    )


def sign_consistency(left_out: DataFrame) -> DataFrame:
    """Range of leave-one-out estimates and the share with the majority sign."""
    up = F.avg((F.col("estimate") > 0).cast("double"))
    return left_out.agg(
        F.count(F.lit(1)).alias("n_units"), F.min("estimate").alias("min_estimate"), F.max("estimate").alias("max_estimate"),
        F.greatest(up, F.lit(1.0) - up).alias("share_same_sign"),
    )


def linear_fit(df: DataFrame, *, outcome: str, regressors: Sequence[str]) -> DataFrame:
    """Pooled least squares with intercept: slopes and R squared.

    One row of centred cross products reaches the driver, and only the k x k solve runs there.
    """
    names = list(regressors)
    usable = df.dropna(subset=[outcome, *names])
    columns = [*names, outcome]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = usable.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.covar_pop(a, b).alias(f"c_{i}") for i, (a, b) in enumerate(pairs)],
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
    ).first()
    value = {pair: row[f"c_{i}"] for i, pair in enumerate(pairs)}
    value.update({(b, a): v for (a, b), v in list(value.items())})
    gram = np.array([[value[a, b] for b in names] for a in names])
    moment = np.array([value[a, outcome] for a in names])
    slope = np.linalg.pinv(gram) @ moment
    explained = float(slope @ moment / value[outcome, outcome]) if value[outcome, outcome] else None
    means = [row[f"m_{i}"] for i in range(len(columns))]
    intercept = float(means[-1] - sum(b * m for b, m in zip(slope, means)))
    terms = [("intercept", intercept), *[(n, float(b)) for n, b in zip(names, slope)]]
    return df.sparkSession.createDataFrame(
        [(t, b, explained, row["n"]) for t, b in terms], "term string, coefficient double, r_squared double, n bigint"
    )


def component_shares(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance shares of the principal components of the feature correlation matrix."""
    names = list(columns)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    row = features.dropna(subset=names).agg(*[F.corr(names[i], names[j]).alias(f"r_{i}_{j}") for i, j in pairs]).first()
    matrix = np.eye(len(names))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = row[f"r_{i}_{j}"]
    values = np.linalg.eigvalsh(matrix)[::-1]
    return features.sparkSession.createDataFrame(
        [(k + 1, float(v), float(v / values.sum())) for k, v in enumerate(values)],
        "component int, eigenvalue double, variance_share double",
    )
