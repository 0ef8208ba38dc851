"""What was known when: publication gates, latest-as-of, exact lags, vintages.

Latest-per-key is an aggregate, not a window: partial aggregation on the map side
keeps one candidate per key and task, so a key with a third of all rows moves a
handful of rows through the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.guards import DataGuardError


class Gate(Enum):
    """Which publication of a repeatedly revised value counts."""

    LAST_BEFORE_DAY = "last publication dated before the target day"
    FIRST_BEFORE_DAY = "first publication dated before the target day"
    LAST_BEFORE_OPEN = "last publication before the target day opens"


def gate_allows(gate: Gate, day: Column, published: Column, *, open_hour: int = 5) -> Column:
    """Publications admitted by a gate, judged on the published clock's own date.

    FIRST_BEFORE_DAY admits any earlier date, not only the day before.
    """
    stamp = published.cast("timestamp_ntz")
    before = stamp.cast("date") < day
    if gate is Gate.LAST_BEFORE_OPEN:
        early = (stamp.cast("date") == day) & (F.hour(stamp) < open_hour)
        return before | early
    return before


def pick_per_key(df: DataFrame, keys: Sequence[str], *, order: Sequence[str],
                 keep: Sequence[str] | None = None, last: bool = True) -> DataFrame:
    """One row per key: the last (or first) in ``order``; one shuffle.

    ``order`` should end in a unique column, else ties fall either way.
    """
    keys = list(keys)
    columns = list(keep) if keep is not None else [c for c in df.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    chosen = (F.max_by if last else F.min_by)(F.struct(*columns), rank)
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in columns]
    )


def select_at_gate(publications: DataFrame, *, gate: Gate = Gate.LAST_BEFORE_DAY, day: str, unit: str,
                   published: str, value: str, tie_break: Sequence[str] = (), open_hour: int = 5) -> DataFrame:
    """The one publication per (day, unit) a decision-maker had.

    Keys without an admitted publication are dropped, never filled from a later one.
    """
    legal = publications.filter(
        gate_allows(gate, F.col(day), F.col(published), open_hour=open_hour)
    ).filter(F.col(day).isNotNull() & F.col(unit).isNotNull())
    return pick_per_key(
        legal.select(day, unit, published, value, *tie_break), [day, unit],
        order=[published, *tie_break], keep=[value, published],
        last=gate is not Gate.FIRST_BEFORE_DAY,
    )


def require_gated(selected: DataFrame, gate: Gate) -> DataFrame:
    """Raise when a gate admits nothing at all (one row is read)."""
    if selected.isEmpty():
        raise DataGuardError(f"no publications satisfy the gate: {gate.value}")
    return selected


def latest_per_key(df: DataFrame, keys: Sequence[str], *, order: Sequence[str],
                   keep: Sequence[str] | None = None) -> DataFrame:
    return pick_per_key(df, keys, order=order, keep=keep, last=True)


def first_per_key(df: DataFrame, keys: Sequence[str], *, order: Sequence[str],
                  keep: Sequence[str] | None = None) -> DataFrame:
    return pick_per_key(df, keys, order=order, keep=keep, last=False)


def entity_key(entity: str, record: str) -> Column:
    """Entity id when present, else the record's own id, in separate name spaces."""
    trimmed = F.regexp_replace(F.col(entity), r"^\s+|\s+$", "")
    return F.when(trimmed != "", F.concat(F.lit("entity "), trimmed)).otherwise(
        F.concat(F.lit("record "), F.col(record))
    )


def latest_as_of(df: DataFrame, *, key: Column, recorded: str, record: str, as_of,
                 keep: Sequence[str], key_name: str = "entity_key") -> DataFrame:
    """Latest record per entity among those recorded by ``as_of``."""
    known = df.filter(F.col(recorded) <= F.lit(as_of)).withColumn(key_name, key)
    columns = [c for c in keep if c != recorded]
    return pick_per_key(
        known.select(key_name, recorded, record, *[c for c in columns if c != record]),
        [key_name], order=[recorded, record], keep=[recorded, *columns],
    )


def exact_lag(df: DataFrame, *, units: Sequence[str], time: str, value: str, output: str,
              step: Column) -> DataFrame:
    """Value of the same unit exactly ``step`` earlier, NULL where that row is absent.

    A join on the shifted key, not ``lag``: a gap must give NULL, not an older row.
    Rows must be unique per (unit, time).
    """
    earlier = df.select(*units, (F.col(time) + step).cast(df.schema[time].dataType).alias(time),
                        F.col(value).alias(output))
    return df.join(earlier, [*units, time], "left")


def seasonal_naive(df: DataFrame, *, units: Sequence[str], time: str, value: str,
                   output: str = "seasonal_naive", lag_days: int = 7) -> DataFrame:
    return exact_lag(df, units=units, time=time, value=value, output=output,
                     step=F.make_dt_interval(days=F.lit(lag_days)))


def month_lag(df: DataFrame, *, units: Sequence[str], month: str, value: str, output: str,
              months: int = 1) -> DataFrame:
    """Value exactly ``months`` calendar months earlier."""
    earlier = df.select(*units, F.add_months(F.col(month), months).alias(month),
                        F.col(value).alias(output))
    return df.join(earlier, [*units, month], "left")


def unseen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``seen``."""
    return df.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def vintage_diff(old: DataFrame, new: DataFrame, *, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Row-level restatement: one row per key with both values and what happened to it."""
    before = old.select(*keys, F.lit(True).alias("_in_old"), *[F.col(v).alias(f"{v}_old") for v in values])
    after = new.select(*keys, F.lit(True).alias("_in_new"), *[F.col(v).alias(f"{v}_new") for v in values])
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_old").eqNullSafe(F.col(f"{v}_new"))
    change = (
        F.when(F.col("_in_old").isNull(), F.lit("added"))
        .when(F.col("_in_new").isNull(), F.lit("removed"))
        .when(same, F.lit("same"))
        .otherwise(F.lit("changed"))
    )
    return before.join(after, list(keys), "full_outer").withColumn("change", change).drop("_in_old", "_in_new")


def restated_totals(df: DataFrame, known: Column, *, keys: Sequence[str], totals: Mapping[str, str]) -> DataFrame:
    """``vintage_diff`` between sums over the rows ``known`` by then and over all rows, in one aggregate.

    ``totals`` maps a name to the column summed. A null key equals no other, as in a join.
    """
    sums = [F.sum(F.when(known, F.col(c))).alias(f"{v}_old") for v, c in totals.items()]
    sums += [F.sum(c).alias(f"{v}_new") for v, c in totals.items()]
    out = df.groupBy(*keys).agg(F.coalesce(F.bool_or(known), F.lit(False)).alias("_in_old"), *sums)
    same, joined = F.lit(True), F.lit(True)
    for v in totals:
        same = same & F.col(f"{v}_old").eqNullSafe(F.col(f"{v}_new"))
    for key in keys:
        joined = joined & F.col(key).isNotNull()
    change = F.when(~F.col("_in_old"), F.array(F.lit("added")))
    change = change.when(~joined, F.array(F.lit("removed"), F.lit("added"))).when(same, F.array(F.lit("same"))).otherwise(F.array(F.lit("changed")))
    out = out.withColumn("_joined", joined).withColumn("change", F.explode(change))
    side = [F.when(F.col("_joined") | (F.col("change") == kind), F.col(f"{v}_{end}")).alias(f"{v}_{end}")
            for end, kind in (("old", "removed"), ("new", "added")) for v in totals]
    return out.select(*keys, *side, "change")


def revision_stats(df: DataFrame, *, first: str, final: str, tolerance: float = 1e-9) -> DataFrame:
    """Restatement between two vintages of the same rows, in one aggregate."""
    revision = F.col(final) - F.col(first)
    pair = F.col(first).isNotNull() & F.col(final).isNotNull()
    return df.filter(pair).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(revision).alias("mean_revision"),
        F.avg(F.abs(revision)).alias("mean_abs_revision"),
        F.try_divide(F.avg(F.abs(revision)) * 100.0, F.avg(first)).alias("pct_of_mean_level"),
        F.avg((F.abs(revision) < tolerance).cast("double")).alias("share_equal"),
    )
