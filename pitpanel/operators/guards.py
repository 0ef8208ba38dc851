"""Checks that refuse bad data instead of carrying it on.

Checks on names read the schema only.  Checks on rows run one small aggregate
job and raise on the driver; ``assert_in_plan`` raises inside the running job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REALISED_SUFFIX = "_realised"


class DataGuardError(ValueError):
    """A guard refused the data."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise DataGuardError(f"missing columns: {missing}")
    return df


def assert_point_in_time(columns: Iterable[str]) -> None:
    """Refuse after-the-fact columns where only knowable ones are allowed."""
    late = sorted(c for c in columns if c.endswith(REALISED_SUFFIX))
    if late:
        raise DataGuardError(f"after-the-fact columns used as features: {late}")


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def scored_rows(df: DataFrame, *, time: str, start, needed: Sequence[str]) -> DataFrame:
    """Rows from ``start`` on where target, incumbent and headline all exist."""
    keep = F.col(time) >= F.lit(start)
    for name in needed:
        keep = keep & F.col(name).isNotNull()
    return df.filter(keep)


def refuse_rows(df: DataFrame, bad: Column, example: Column | str, message: str) -> DataFrame:
    """Raise with a count and up to three examples when any row is ``bad``."""
    shown = F.col(example) if isinstance(example, str) else example
    hits = df.filter(bad)
    count = hits.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if count:
        some = [r[0] for r in hits.select(shown.cast("string")).limit(3).collect()]
        raise DataGuardError(f"{count} {message}; examples: {some}")
    return df


def assert_in_plan(value: Column, bad: Column, message: str) -> Column:
    """``value``, but a bad row fails the job that computes it; no extra pass."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def require_units(df: DataFrame, unit: str, expected: DataFrame) -> DataFrame:
    """Refuse a panel in which an expected unit has no row at all."""
    absent = missing_units(df, unit, expected)
    count, some = _examples(absent, unit)
    if count:
        raise DataGuardError(f"{count} units absent, refusing a partial panel; first: {some}")
    return df


def _examples(rows: DataFrame, column: str) -> tuple[int, list]:
    """How many rows there are, and the first 20 values for the message."""
    return rows.count(), [r[0] for r in rows.orderBy(column).limit(20).collect()]


def missing_units(df: DataFrame, unit: str, expected: DataFrame) -> DataFrame:
    """Expected units without a row.

    Distinct first: the anti join then moves one row per unit, not the panel.
    """
    present = df.select(unit).filter(F.col(unit).isNotNull()).distinct()
    return expected.select(unit).distinct().join(present, unit, "left_anti")


def require_same_codes(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Refuse unless both sides hold the same set of codes."""
    extra = df.select(column).distinct().join(expected.select(column).distinct(), column, "left_anti")
    (n_extra, unknown), (n_absent, absent) = _examples(extra, column), _examples(missing_units(df, column, expected), column)
    if n_extra or n_absent:
        raise DataGuardError(f"codes differ: unknown {unknown} ({n_extra} in all), absent {absent} ({n_absent} in all)")
    return df


def join_coverage(left: DataFrame, joined: DataFrame) -> DataFrame:
    """One row: rows in ``left``, rows matched, and their ratio."""
    return left.agg(F.count(F.lit(1)).alias("n_left")).select(
        "n_left",
        joined.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_matched"),
    ).select(
        "n_left",
        "n_matched",
        (F.col("n_matched") / F.greatest(F.col("n_left"), F.lit(1))).alias("ratio"),
    )


def require_coverage(left: DataFrame, joined: DataFrame, *, minimum: float = 0.99) -> DataFrame:
    row = join_coverage(left, joined).first()
    if row["ratio"] < minimum:
        raise DataGuardError(
            f"only {row['n_matched']} of {row['n_left']} rows matched ({row['ratio']:.1%}); "
            f"refusing a partial join"
        )
    return joined


def shared_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on both sides; empty when two sets are disjoint."""
    return left.select(*keys).join(right.select(*keys), list(keys), "left_semi").distinct()


def up_to(df: DataFrame, day: str, as_of, *, lag_days: int = 0) -> DataFrame:
    """Rows up to ``lag_days`` before an explicit as-of date."""
    return df.filter(F.col(day) <= F.date_sub(F.lit(as_of).cast("date"), lag_days))
