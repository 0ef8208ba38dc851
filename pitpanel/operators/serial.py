"""Serial dependence: lagged products, effective sample size, loss-differential test.

Lag k means k rows back in the group's order.  Every table takes one path: the order is cut at
measured quantiles into chunks of about ``chunk_rows`` rows, each (group, chunk) is sorted in one
task and gives its own lagged products with its first and last ``max_lag`` rows, and a group's
chunks are then put together from these edges, in order.  So one endless series spreads over the
cluster, the sums are exact, and rows are shuffled once whatever the number of series of values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_LAG = 48
CHUNK_ROWS = 1_000_000


def _ordinal(df: DataFrame, name: str) -> Column:
    """Order column as a double that is monotone in it."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):  # the first six bytes keep the order of the texts
        return F.conv(F.rpad(F.hex(F.substring(F.encode(name, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


def _chunk(rows: DataFrame, first: Column, chunk_rows: int) -> Column:
    """Number of the chunk by quantiles of ``first``: rows of equal order share one, whatever the spacing."""
    n = rows.count()
    chunks = max(1, math.ceil(n / chunk_rows))
    if chunks == 1:
        return F.lit(0)
    shares = [k / chunks for k in range(1, chunks)]
    cuts = np.array(rows.agg(F.percentile_approx(first, shares, 10 * chunks)).first()[0])

    @F.pandas_udf(T.IntegerType())
    def number(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), side="right").astype("int32"))

    return number(first)


def _own_products(x: np.ndarray, max_lag: int) -> np.ndarray:
    """(series, lags) sums of x[i] x[i - k] over the rows of ``x`` (series, rows)."""
    n = x.shape[1]
    return np.stack([(x[:, k:] * x[:, :n - k]).sum(axis=1) if k < n else np.zeros(len(x)) for k in range(max_lag + 1)], axis=1)


def _cross_products(before: np.ndarray, after: np.ndarray, max_lag: int) -> np.ndarray:
    """The same sums over pairs of a row of ``before`` and a row of ``after``, which follows it."""
    out, p, h = np.zeros((len(before), max_lag + 1)), before.shape[1], after.shape[1]
    both = np.concatenate([before, after], axis=1)
    for k in range(1, max_lag + 1):
        low, high = max(0, p - k), min(p, p + h - k)
        if low < high:
            out[:, k] = (both[:, low:high] * both[:, low + k:high + k]).sum(axis=1)
    return out


def lag_products_of(df: DataFrame, *, values: Mapping[str, Column | str], order: Sequence[str], group: Sequence[str] = (),
                    max_lag: int = DEFAULT_MAX_LAG, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per group and label of ``values``: (label, n, mean, lag_products), the array of centred lagged products, index = lag.

    ``order`` must be a total order within the group. Rows where any of the values is missing are
    left out. Eager: the rows are counted, and with more than one chunk quantiles are measured.
    """
    group, order, labels = list(group), list(order), list(values)
    xs = [(F.col(v) if isinstance(v, str) else v).cast("double") for v in values.values()]
    names = [f"g{k}" for k in range(len(group))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)], _ordinal(df, order[0]).alias("at"),
                     *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], *[x.alias(f"x{k}") for k, x in enumerate(xs)])
    rows = rows.dropna(subset=[f"x{k}" for k in range(len(xs))])
    rows = rows.withColumn("chunk", _chunk(rows, F.coalesce("at", F.lit(float("-inf"))), chunk_rows))
    kinds = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    sort_by = [(f"o{k}", "ascending") for k in range(len(order))]

    def chunk_sums(table):
        import pyarrow as pa
        from pyarrow import compute

        # A group's mean is not known yet: products are taken about the chunk's own mean and moved later.
        table = table.take(compute.sort_indices(table, sort_keys=sort_by, null_placement="at_start"))
        x = np.stack([table.column(f"x{k}").to_numpy() for k in range(len(labels))])
        mean = x.mean(axis=1)
        centred = x - mean[:, None]
        n, flat = x.shape[1], pa.list_(pa.float64())
        one = {"n": pa.array([n]), "mean": pa.array([mean.tolist()], flat),
               "products": pa.array([_own_products(centred, max_lag).ravel().tolist()], flat),
               "head": pa.array([centred[:, :max_lag].ravel().tolist()], flat),
               "tail": pa.array([centred[:, max(0, n - max_lag):].ravel().tolist()], flat)}
        return pa.table({**{g: table.column(g).slice(0, 1) for g in names}, "chunk": table.column("chunk").slice(0, 1), **one})

    sums = rows.groupBy(*names, "chunk").applyInArrow(
        chunk_sums, f"{kinds}chunk int, n bigint, mean array<double>, products array<double>, head array<double>, tail array<double>")

    def joined(table):
        import pyarrow as pa

        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "n", "mean", "products", "head", "tail")), strict=True))
        m = len(labels)
        total = sum(p[1] for p in parts)
        mean = sum(p[1] * np.array(p[2]) for p in parts) / total
        out, before = np.zeros((m, max_lag + 1)), np.zeros((m, 0))
        for _, n, own, products, head, tail in parts:
            head, tail, shift = (np.array(head).reshape(m, -1), np.array(tail).reshape(m, -1), np.array(own) - mean)
            # Sum of (c[i] + d)(c[i - k] + d) with sum of all c zero: left-out ends are the first and last k rows.
            first, last = (np.concatenate([np.zeros((m, 1)), np.cumsum(e, axis=1)], axis=1) for e in (head, tail[:, ::-1]))
            lags = np.arange(max_lag + 1)
            some = lags < n
            moved = np.array(products).reshape(m, -1)
            moved[:, some] += shift[:, None] * -(first[:, lags[some]] + last[:, lags[some]]) + shift[:, None] ** 2 * (n - lags[some])
            head, tail = head + shift[:, None], tail + shift[:, None]
            out += moved + _cross_products(before, head, max_lag)
            before = np.concatenate([before, tail], axis=1)[:, -max_lag:] if max_lag else before
        return pa.table({**{g: table.column(g).take(pa.array([0] * m)) for g in names}, "label": pa.array(labels),
                         "n": pa.array([total] * m), "mean": pa.array(mean), "lag_products": pa.array(out.tolist(), pa.list_(pa.float64()))})

    found = sums.groupBy(*names).applyInArrow(joined, f"{kinds}label string, n bigint, mean double, lag_products array<double>")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, group, strict=True)], "label", "n", "mean", "lag_products")


def lag_products(df: DataFrame, *, value: Column | str, order: Sequence[str], group: Sequence[str] = (),
                 max_lag: int = DEFAULT_MAX_LAG, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``lag_products_of`` one value: per group n, mean and lag_products."""
    return lag_products_of(df, values={"": value}, order=order, group=group, max_lag=max_lag, chunk_rows=chunk_rows).drop("label")


def effective_n(products: DataFrame) -> DataFrame:
    """n / (1 + 2 sum of autocorrelations up to the first that is not positive), at least 1."""
    g0 = F.element_at("lag_products", 1)
    rho = F.transform(F.slice("lag_products", 2, F.size("lag_products") - 1), lambda g: g / g0)
    stop = F.array_position(F.transform(rho, lambda r: r <= 0), True)
    taken = F.slice(rho, F.lit(1), F.when(stop == 0, F.size(rho)).otherwise(stop - 1).cast("int"))
    inflation = F.lit(1.0) + F.lit(2.0) * F.aggregate(taken, F.lit(0.0), lambda acc, r: acc + r)
    n = F.col("n").cast("double")
    value = (
        F.when(F.col("n") < 3, F.greatest(n, F.lit(1.0)))
        .when(g0 == 0, n)
        .otherwise(F.greatest(n / inflation, F.lit(1.0)))
    )
    return products.withColumn("n_effective", value).drop("lag_products", "mean")


def effective_sample_size(df: DataFrame, *, value: Column | str, order: Sequence[str], group: Sequence[str] = (),
                          max_lag: int = DEFAULT_MAX_LAG, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return effective_n(lag_products(df, value=value, order=order, group=group, max_lag=max_lag,
                                    chunk_rows=chunk_rows))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value; Spark has no error function, and this sees one row per test."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore").astype("float64")


def diebold_mariano(df: DataFrame, *, error_a: Column | str, error_b: Column | str, order: Sequence[str],
                    group: Sequence[str] = (), power: int = 2, max_lag: int = DEFAULT_MAX_LAG,
                    with_p_value: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Equal-loss test with a Bartlett long-run variance; positive means a loses more.

    Fewer than 10 pairs or a non-positive variance give NULL.
    """
    a = F.col(error_a) if isinstance(error_a, str) else error_a
    b = F.col(error_b) if isinstance(error_b, str) else error_b
    loss = F.pow(F.abs(a), F.lit(power)) - F.pow(F.abs(b), F.lit(power))
    sums = lag_products(df, value=loss, order=order, group=group, max_lag=max_lag, chunk_rows=chunk_rows)
    n = F.col("n").cast("double")
    lags = F.least(F.lit(max_lag), F.col("n") - 1)
    weighted = F.transform(
        "lag_products",
        lambda g, k: F.when(k == 0, g).when(k <= lags, F.lit(2.0) * (F.lit(1.0) - k / (lags + 1)) * g).otherwise(0.0),
    )
    variance = F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v) / n
    enough = F.col("n") >= 10
    out = sums.select(
        *group,
        "n",
        F.when(enough, F.col("mean")).alias("mean_loss_differential"),
        F.when(enough & (variance > 0), F.col("mean") / F.sqrt(variance / n)).alias("statistic"),
    )
    return out.withColumn("p_value", two_sided_p("statistic")) if with_p_value else out
