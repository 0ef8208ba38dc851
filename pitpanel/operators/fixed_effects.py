"""Two-way fixed effects, cluster-robust errors and the wild cluster bootstrap.

The panel is touched by aggregates only: unit and period means to absorb the
effects, then one row of cross products per cluster.  Every estimate, variance and
bootstrap draw is algebra on those cluster rows.  ``keys`` runs independent
regressions side by side (replications, left-out units) as extra group columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions import draws
from pitpanel.operators.guards import DataGuardError
from pitpanel.session import cut_lineage

TOLERANCE = 1e-10
MAX_STEPS = 500
#: Share of a column's size that rounding may leave in its residual's norm.
ROUNDING = 1e-12


def absorb_balanced(df: DataFrame, columns: Sequence[str], *, unit: str, period: str, keys: Sequence[str] = (),
                    suffix: str = "_within") -> DataFrame:
    """Balanced panels: ``x - unit mean - period mean + mean`` is exact.

    Means are aggregates joined back, so a unit with most of the rows is summed on
    the map side instead of gathered in one window partition.
    """
    keys = list(keys)
    out = df
    for side, by in (("u", [*keys, unit]), ("p", [*keys, period]), ("g", keys)):
        means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_{side}_{c}") for c in columns])
        if by:
            out = out.join(means, by, "left")
        else:
            out = out.withColumns({f"_g_{c}": means.select(f"_g_{c}").scalar() for c in columns})
    return out.select(*df.columns, *[
        (F.col(c) - F.col(f"_u_{c}") - F.col(f"_p_{c}") + F.col(f"_g_{c}")).alias(c + suffix) for c in columns
    ])


def is_balanced(df: DataFrame, *, unit: str, period: str, single: bool = False) -> bool:
    """Every unit observed equally often (``single``: exactly once) in every period; one aggregate of cell counts."""
    cells = df.groupBy(unit, period).agg(F.count(F.lit(1)).alias("n"))
    row = cells.agg(
        F.count(F.lit(1)).alias("cells"), F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.count_distinct(unit).alias("units"), F.count_distinct(period).alias("periods"),
    ).first()
    if not row["cells"] or (single and row["hi"] > 1):
        return False
    return row["lo"] == row["hi"] and row["cells"] == row["units"] * row["periods"]


def absorb_unbalanced(df: DataFrame, columns: Sequence[str], *, unit: str, period: str, keys: Sequence[str] = (),
                      suffix: str = "_within", tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> DataFrame:
    """Unbalanced panels: the effects solve the normal equations, by conjugate gradients on the effect tables.

    Unit effects are eliminated, so the unknowns are the period effects; a step multiplies them by the
    (unit, period) counts once in each direction, all columns and keys together.  The values are read
    for the cell sums and for the final subtraction only.  A step's tables are stored, so plans stay
    one step deep.  Steps end when the residual's norm is ``tolerance`` of the first one, or ROUNDING
    of the column's.
    """
    keys, names = list(keys), range(len(columns))
    by_unit, by_period = [*keys, unit], [*keys, period]
    cells = cut_lineage(df.groupBy(*keys, unit, period).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(c).cast("double").alias(f"_s{k}") for k, c in enumerate(columns)]))
    units = cut_lineage(cells.groupBy(*by_unit).agg(F.sum("_n").alias("_mu"), *[(F.sum(f"_s{k}") / F.sum("_n")).alias(f"_u{k}") for k in names]))

    def scalars(table: DataFrame, sums: dict[str, Column]) -> DataFrame:
        return table.groupBy(*keys).agg(*[F.sum(x).alias(name) for name, x in sums.items()])

    def beside(table: DataFrame, numbers: DataFrame) -> DataFrame:
        """``table`` with its key's numbers, of which there are a few."""
        if keys:
            return table.join(cut_lineage(numbers), keys)
        row = numbers.first()
        return table.withColumns({c: F.lit(row[c]).cast("double") for c in numbers.columns})

    gap = cells.join(units, by_unit).groupBy(*by_period).agg(
        F.sum("_n").alias("_m"), *[F.sum(F.col(f"_s{k}") - F.col("_n") * F.col(f"_u{k}")).alias(f"_r{k}") for k in names])
    state = cut_lineage(gap.select(*by_period, "_m", *[F.lit(0.0).alias(f"_x{k}") for k in names], *[F.col(f"_r{k}") for k in names],
                                   *[(F.col(f"_r{k}") / F.col("_m")).alias(f"_d{k}") for k in names]))
    norms = {f"_rz{k}": F.col(f"_r{k}") * F.col(f"_r{k}") / F.col("_m") for k in names}
    # What is left by rounding alone, of a column that is nothing but effects, say, never gets smaller.
    first, scale = scalars(state, norms), scalars(cells, {f"_scale{k}": F.col(f"_s{k}") * F.col(f"_s{k}") / F.col("_n") for k in names})
    first = first.join(scale, keys) if keys else first.select(*first.columns, *[scale.select(c).scalar().alias(c) for c in scale.columns])
    first = cut_lineage(first.select(*keys, *[F.col(f"_rz{k}").alias(f"_first{k}") for k in names], *[f"_scale{k}" for k in names]))
    for step in range(max_steps + 1):
        now = scalars(state, norms)
        both = now.join(first, keys) if keys else now.select(*now.columns, *[first.select(c).scalar().alias(c) for c in first.columns])
        shares = [F.when(F.col(f"_rz{k}") > ROUNDING**2 * F.col(f"_scale{k}"), F.try_divide(F.col(f"_rz{k}"), F.col(f"_first{k}"))) for k in names]
        left = both.agg(F.max(F.greatest(F.lit(0.0), F.lit(0.0), *shares))).first()[0]
        if (left or 0.0) <= tolerance**2:
            break
        if step == max_steps:
            raise DataGuardError(f"effects still {left**0.5:.3g} off after {max_steps} steps (tolerance {tolerance:.3g})")
        pulled = cells.join(state.select(*by_period, *[f"_d{k}" for k in names]), by_period).groupBy(*by_unit).agg(
            *[(F.sum(F.col("_n") * F.col(f"_d{k}")) / F.sum("_n")).alias(f"_t{k}") for k in names])
        back = cells.join(pulled, by_unit).groupBy(*by_period).agg(*[F.sum(F.col("_n") * F.col(f"_t{k}")).alias(f"_t{k}") for k in names])
        state = cut_lineage(state.join(back, by_period).select(
            *state.columns, *[(F.col("_m") * F.col(f"_d{k}") - F.col(f"_t{k}")).alias(f"_q{k}") for k in names]))
        state = beside(state, scalars(state, {**norms, **{f"_dq{k}": F.col(f"_d{k}") * F.col(f"_q{k}") for k in names}}))
        size = {k: F.coalesce(F.try_divide(F.col(f"_rz{k}"), F.col(f"_dq{k}")), F.lit(0.0)) for k in names}
        state = state.select(*by_period, "_m", *[F.col(f"_rz{k}").alias(f"_old{k}") for k in names], *[f"_d{k}" for k in names],
                             *[(F.col(f"_x{k}") + size[k] * F.col(f"_d{k}")).alias(f"_x{k}") for k in names],
                             *[(F.col(f"_r{k}") - size[k] * F.col(f"_q{k}")).alias(f"_r{k}") for k in names])
        state = beside(state, scalars(state, norms))
        turn = {k: F.coalesce(F.try_divide(F.col(f"_rz{k}"), F.col(f"_old{k}")), F.lit(0.0)) for k in names}
        state = cut_lineage(state.select(*by_period, "_m", *[f"_x{k}" for k in names], *[f"_r{k}" for k in names],
                                         *[(F.col(f"_r{k}") / F.col("_m") + turn[k] * F.col(f"_d{k}")).alias(f"_d{k}") for k in names]))
    shift = cells.join(state, by_period).groupBy(*by_unit).agg(*[F.sum(F.col("_n") * F.col(f"_x{k}")).alias(f"_t{k}") for k in names])
    # Names that the panel's own columns hardly have.
    effects = units.join(shift, by_unit).select(*by_unit, *[(F.col(f"_u{k}") - F.col(f"_t{k}") / F.col("_mu")).alias(f"_effect_of_unit_{k}") for k in names])
    periods = state.select(*by_period, *[F.col(f"_x{k}").alias(f"_effect_of_period_{k}") for k in names])
    return df.join(effects, by_unit, "left").join(periods, by_period, "left").select(*df.columns, *[
        (F.col(c) - F.col(f"_effect_of_unit_{k}") - F.col(f"_effect_of_period_{k}")).alias(c + suffix) for k, c in enumerate(columns)])


def panel_components(df: DataFrame, *, unit: str, period: str) -> DataFrame:
    """(unit, component): units that share periods, directly or through others; component is the smallest period reached.

    Effects are comparable within a component only.  Smallest labels go from periods to units
    and back until none changes; a round is two aggregates of the distinct cells.  Eager.
    """
    cells = cut_lineage(df.select(unit, period).dropna().distinct())
    labels, before = cells.select(period, F.col(period).alias("component")).distinct(), None
    while True:
        units = cells.join(labels, period).groupBy(unit).agg(F.min("component").alias("component"))
        labels = cut_lineage(cells.join(units, unit).groupBy(period).agg(F.min("component").alias("component")))
        state = labels.agg(F.count_distinct("component"), F.bit_xor(F.xxhash64(period, "component"))).first()
        if state == before:
            return cut_lineage(cells.join(labels, period).groupBy(unit).agg(F.min("component").alias("component")))
        before = state


def require_connected(df: DataFrame, *, unit: str, period: str) -> None:
    """Refuse a panel whose units fall into groups without a common period: their effects cannot be told from the groups'."""
    sizes = panel_components(df, unit=unit, period=period).groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy("component").limit(5).collect()
    if len(sizes) > 1:
        raise DataGuardError("units without common periods: " + ", ".join(f"{r['n']} units from {r['component']}" for r in sizes))


def absorb(df: DataFrame, columns: Sequence[str], *, unit: str, period: str, keys: Sequence[str] = (),
           suffix: str = "_within", balanced: bool | None = None, unit_effects: bool = True,
           period_effects: bool = True, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> DataFrame:
    """Remove unit and period means.  One set alone still removes the overall mean; none removes nothing."""
    if not unit_effects and not period_effects:
        return df.withColumns({c + suffix: F.col(c) for c in columns})
    if not (unit_effects and period_effects):
        by = [*keys, unit if unit_effects else period]
        means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
        return df.join(means, by, "left").select(
            *df.columns, *[(F.col(c) - F.col(f"_m_{c}")).alias(c + suffix) for c in columns]
        )
    if balanced is None:
        balanced = not keys and is_balanced(df, unit=unit, period=period)
    if balanced:
        return absorb_balanced(df, columns, unit=unit, period=period, keys=keys, suffix=suffix)
    return absorb_unbalanced(df, columns, unit=unit, period=period, keys=keys, suffix=suffix, tolerance=tolerance, max_steps=max_steps)


def cluster_blocks(within: DataFrame, *, outcome: str, regressors: Sequence[str], cluster: str,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Per (keys, cluster): n, sums, and cross products ``xx_i_j`` (i <= j), ``xy_i``, ``yy``."""
    k = range(len(regressors))
    x = [F.col(r) for r in regressors]
    y = F.col(outcome)
    return within.groupBy(*keys, F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("sy"),
        F.sum(y * y).alias("yy"),
        *[F.sum(x[i]).alias(f"sx_{i}") for i in k],
        *[F.sum(x[i] * y).alias(f"xy_{i}") for i in k],
        *[F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i in k for j in k if i <= j],
    )


def _xx(i: int, j: int) -> str:
    return f"xx_{min(i, j)}_{max(i, j)}"


def _dot(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [a * b for a, b in zip(left, right)])


def _projections(k: int):
    """Per key: beta, and for each target its row of (X'X)^-1 and the restricted beta."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                gram = np.array([[row[_xx(i, j)] for j in range(k)] for i in range(k)], dtype="float64")
                moment = np.array([row[f"xy_{i}"] for i in range(k)], dtype="float64")
                inverse = np.linalg.pinv(gram)
                beta = inverse @ moment
                for target in range(k):
                    keep = [i for i in range(k) if i != target]
                    null = np.zeros(k)
                    if keep:
                        null[keep] = np.linalg.pinv(gram[np.ix_(keep, keep)]) @ moment[keep]
                    rows.append({**row.to_dict(), "target": target, "beta": beta.tolist(),
                                 "inverse": inverse.ravel().tolist(), "restricted": null.tolist()})
            yield pd.DataFrame(rows, columns=[*pdf.columns, "target", "beta", "inverse", "restricted"])

    return solve


def projections(blocks: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, target): totals, ``beta``, ``inverse`` (row-major), ``restricted``."""
    summed = [c for c in blocks.columns if c not in keys and c != "cluster"]
    totals = blocks.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in summed],
                                       F.count(F.lit(1)).alias("n_clusters"))
    if k == 1:
        xx = F.col("xx_0_0")
        inverse = F.when(xx > 0, F.lit(1.0) / xx).otherwise(0.0)
        return totals.select(
            *totals.columns, F.lit(0).alias("target"), F.array(inverse * F.col("xy_0")).alias("beta"),
            F.array(inverse).alias("inverse"), F.array(F.lit(0.0)).alias("restricted"),
        )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in totals.schema.fields)
    return totals.mapInPandas(
        _projections(k), schema=f"{schema}, target int, beta array<double>, inverse array<double>, restricted array<double>"
    )


def _attach(blocks: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put each key's few projection rows beside its cluster rows."""
    if keys:
        return blocks.join(table, list(keys))
    # Without keys the table has one row per regressor: read it off as one array.
    packed = table.agg(F.collect_list(F.struct(*table.columns))).scalar()
    return blocks.withColumn("_p", F.explode(packed)).select(*blocks.columns, "_p.*")


def _solution(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.select(*keys, "target", "beta", "inverse", "restricted",
                        F.col("n").alias("_N"), F.col("n_clusters").alias("_G"))


def fit_from_blocks(blocks: DataFrame, names: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Estimate, cluster-robust error and t per (keys, regressor).

    The variance carries ``G/(G-1) * (N-1)/(N-k)``.
    """
    k, keys = len(names), list(keys)
    ks = range(k)
    table = projections(blocks, k, keys)
    side = _attach(blocks, _solution(table, keys), keys)
    beta = [F.get("beta", F.lit(j)) for j in ks]
    row = [F.get("inverse", F.col("target") * k + F.lit(j)) for j in ks]
    score = [F.col(f"xy_{i}") - _dot([F.col(_xx(i, j)) for j in ks], beta) for i in ks]
    meat = side.groupBy(*keys, "target").agg(F.sum(F.pow(_dot(row, score), F.lit(2))).alias("_meat"))
    n, g = F.col("n").cast("double"), F.col("n_clusters").cast("double")
    correction = F.try_divide(g, g - 1.0) * (n - 1.0) / F.greatest(n - k, F.lit(1.0))
    rss = F.col("yy") - 2.0 * _dot(beta, [F.col(f"xy_{i}") for i in ks]) + reduce(
        lambda a, b: a + b, [beta[i] * beta[j] * F.col(_xx(i, j)) for i in ks for j in ks]
    )
    residual_sum = F.col("sy") - _dot(beta, [F.col(f"sx_{i}") for i in ks])
    spread = F.sqrt(F.greatest(F.try_divide(rss - residual_sum * residual_sum / n, n - 1.0), F.lit(0.0)))
    name = F.get(F.array(*[F.lit(c) for c in names]), F.col("target"))
    se = F.sqrt(F.col("_meat") * correction)
    return (
        table.join(meat, [*keys, "target"])
        .select(*keys, "target", name.alias("regressor"), F.get("beta", F.col("target")).alias("estimate"),
                se.alias("cluster_se"), F.col("n").alias("n_obs"), "n_clusters", spread.alias("residual_sd"))
        .withColumn("t_stat", F.when(F.col("cluster_se") > 0, F.col("estimate") / F.col("cluster_se")))
    )


#: Cluster rows and draws of one matrix product, and bytes of partial sums that a task holds before it hands them on.
ROWS_AT_ONCE, DRAWS_AT_ONCE, HELD_BYTES = 1024, 4096, 64_000_000


def _signed_sums(names: Sequence[str], by: Sequence[str], count: int | None, seed: int | None):
    """Sums of sign x column over the cluster rows of a task, for each draw: (by, draw, names).

    Signs are made here, a matrix of rows x draws at a time, and never leave the task.
    ``seed=None`` lists all 2^G vectors: draw d gives the cluster of place b the sign of bit b.
    """

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def rows():
            for key, sums in held.items():
                yield pd.DataFrame({**dict(zip(by, key)), "draw": np.arange(sums.shape[1]), **dict(zip(names, sums))})
            held.clear()

        size = 0
        for pdf in batches:
            for key, part in ((key, rows_.iloc[at:at + ROWS_AT_ONCE]) for key, rows_ in pdf.groupby(list(by), sort=False)
                              for at in range(0, len(rows_), ROWS_AT_ONCE)):
                n = count if seed is not None else 1 << int(part["_clusters"].iloc[0])
                if key not in held:
                    if size + n * len(names) * 8 > HELD_BYTES:
                        yield from rows()
                        size = 0
                    held[key], size = np.zeros((len(names), n)), size + n * len(names) * 8
                values = part[list(names)].to_numpy(np.float64).T
                for at in range(0, n, DRAWS_AT_ONCE):
                    to = min(n, at + DRAWS_AT_ONCE)
                    if seed is not None:
                        w = draws.signs(seed, part["_text"].tolist(), at, to)
                    else:
                        w = (np.arange(at, to)[None, :] >> part["_bit"].to_numpy(np.int64)[:, None] & 1) * 2.0 - 1.0
                    held[key][:, at:to] += values @ w
        yield from rows()

    return run


MAX_ENUMERATED_CLUSTERS = 20


def bootstrap_t(blocks: DataFrame, k: int, *, keys: Sequence[str] = (), count: int | None = 999,
                seed: int | None = draws.SEED, small_sample: bool = False) -> DataFrame:
    """Restricted wild cluster bootstrap: ``t_star`` per (keys, target, draw).

    The null fit and residual enter as per-cluster vectors.  With c = the target's row of
    the inverse, u = c'f, v = c'r, q = A c and signs w, the draw's variance is
    sum (u + w v - q'b)^2, and as w^2 = 1, all that depends on the draw are the sums of
    w r, w u v and w v q over clusters: products of a few columns with the matrix of signs, taken
    in every task over its own clusters.  No row is made for a cluster and draw.
    """
    keys, ks = list(keys), range(k)
    if seed is None:
        widest = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("g")).agg(F.max("g")).first()[0]
        if widest and widest > MAX_ENUMERATED_CLUSTERS:
            raise DataGuardError(f"{widest} clusters have too many sign vectors to list; give a seed")
    table = projections(blocks, k, keys)
    side = _attach(blocks, _solution(table, keys), keys)
    null = [F.get("restricted", F.lit(j)) for j in ks]
    c = [F.get("inverse", F.col("target") * k + F.lit(j)) for j in ks]
    fit = [_dot([F.col(_xx(i, j)) for j in ks], null) for i in ks]
    side = side.withColumns({f"_f{i}": fit[i] for i in ks})
    side = side.withColumns({f"_r{i}": F.col(f"xy_{i}") - F.col(f"_f{i}") for i in ks})
    side = side.withColumns({
        "_u": _dot(c, [F.col(f"_f{i}") for i in ks]),
        "_v": _dot(c, [F.col(f"_r{i}") for i in ks]),
        **{f"_q{j}": _dot(c, [F.col(_xx(i, j)) for i in ks]) for j in ks},
    })
    u, v, by = F.col("_u"), F.col("_v"), [*keys, "target"]
    fixed = side.groupBy(*by).agg(
        F.first("inverse").alias("inverse"), F.first("_N").alias("_N"), F.first("_G").alias("_G"),
        *[F.sum(f"_f{i}").alias(f"_fs{i}") for i in ks], F.sum(u * u + v * v).alias("_uv"),
        *[F.sum(u * F.col(f"_q{j}")).alias(f"_uq{j}") for j in ks],
        *[F.sum(F.col(f"_q{i}") * F.col(f"_q{j}")).alias(f"_qq_{i}_{j}") for i in ks for j in ks if i <= j],
    )
    if seed is None:
        order = Window.partitionBy(*by).orderBy("cluster")
        own_sign = {"_bit": F.row_number().over(order) - 1, "_clusters": F.count(F.lit(1)).over(Window.partitionBy(*by))}
    else:
        own_sign = {"_text": draws.key_text(F.col("cluster"), F.col("target"), *[F.col(name) for name in keys])}
    names = [*[f"_wr{i}" for i in ks], "_wz", *[f"_wq{j}" for j in ks]]
    signed = side.select(
        *by, *[e.alias(name) for name, e in own_sign.items()], *[F.col(f"_r{i}").alias(f"_wr{i}") for i in ks],
        (u * v).alias("_wz"), *[(v * F.col(f"_q{j}")).alias(f"_wq{j}") for j in ks])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signed.select(*by).schema.fields)
    schema = f"{kinds}, draw bigint, " + ", ".join(f"{name} double" for name in names)
    parts = signed.mapInPandas(_signed_sums(names, by, count, seed), schema)
    sums = parts.groupBy(*by, "draw").agg(*[F.sum(name).alias(name) for name in names]).join(fixed, by)
    moment = [F.col(f"_fs{j}") + F.col(f"_wr{j}") for j in ks]
    beta = [_dot([F.get("inverse", F.lit(i * k + j)) for j in ks], moment) for i in ks]
    sums = sums.withColumns({f"_b{i}": beta[i] for i in ks})
    b = [F.col(f"_b{i}") for i in ks]
    variance = F.col("_uv") + 2.0 * F.col("_wz") - 2.0 * _dot(b, [F.col(f"_uq{j}") + F.col(f"_wq{j}") for j in ks]) + reduce(
        lambda x, y: x + y, [b[i] * b[j] * F.col(f"_qq_{min(i, j)}_{max(i, j)}") for i in ks for j in ks]
    )
    if small_sample:
        n, g = F.col("_N").cast("double"), F.col("_G").cast("double")
        variance = variance * F.try_divide(g, g - 1.0) * (n - 1.0) / F.greatest(n - k, F.lit(1.0))
    own = F.get(F.array(*b), F.col("target"))
    return sums.withColumn("_var", variance).select(
        *keys, "target", "draw", F.when(F.col("_var") > 0, own / F.sqrt(F.col("_var"))).alias("t_star")
    )


def bootstrap_p(fits: DataFrame, stars: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """``(exceedances + 1) / (finite draws + 1)`` per estimate row; NULL without a usable t."""
    on = [*keys, "target"]
    observed = fits.select(*on, "t_stat")
    tally = stars.join(observed, on).groupBy(*on).agg(
        F.count("t_star").alias("n_draws"),
        F.count(F.when(F.abs("t_star") >= F.abs("t_stat"), F.lit(1))).alias("n_exceed"),
    )
    p = F.when((F.col("n_draws") > 0) & F.col("t_stat").isNotNull(),
               (F.col("n_exceed") + 1.0) / (F.col("n_draws") + 1.0))
    return fits.join(tally, on, "left").withColumn("wild_p_value", p)


def infer(blocks: DataFrame, names: Sequence[str], *, keys: Sequence[str] = (), bootstrap_draws: int = 999,
          seed: int | None = draws.SEED, small_sample_bootstrap: bool = False) -> DataFrame:
    """Estimates with bootstrap p-values from cluster blocks."""
    fits = fit_from_blocks(blocks, names, keys=keys)
    stars = bootstrap_t(blocks, len(names), keys=keys, count=bootstrap_draws, seed=seed,
                        small_sample=small_sample_bootstrap)
    return bootstrap_p(fits, stars, keys=keys)


def two_way_regression(df: DataFrame, *, outcome: str, regressors: Sequence[str], unit: str, period: str,
                       bootstrap_draws: int = 999, seed: int | None = draws.SEED, unit_effects: bool = True,
                       period_effects: bool = True, balanced: bool | None = None,
                       small_sample_bootstrap: bool = False, connected: bool = False) -> DataFrame:
    """Two-way fixed effects regression clustered by unit, one row per regressor.

    ``connected`` refuses a panel whose units fall into groups without a common period.

    The observed t has the small-sample correction and the bootstrap t has not, unless
    ``small_sample_bootstrap`` asks for both.
    """
    names = list(regressors)
    usable = df.dropna(subset=[outcome, *names, unit, period]).select(unit, period, outcome, *names)
    if usable.isEmpty():
        raise DataGuardError("no complete rows for the requested regression")
    if connected:
        require_connected(usable, unit=unit, period=period)
    within = absorb(usable, [outcome, *names], unit=unit, period=period, balanced=balanced,
                    unit_effects=unit_effects, period_effects=period_effects)
    # A few numbers per cluster are kept, so that fit and bootstrap do not read the panel again.
    blocks = cut_lineage(cluster_blocks(within, outcome=f"{outcome}_within",
                                        regressors=[f"{r}_within" for r in names], cluster=unit))
    result = infer(blocks, names, bootstrap_draws=bootstrap_draws, seed=seed,
                   small_sample_bootstrap=small_sample_bootstrap)
    periods = usable.agg(F.count_distinct(period)).scalar()
    return result.withColumns({"n_units": F.col("n_clusters"), "n_periods": periods}).drop("target")
