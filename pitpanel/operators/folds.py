"""Expanding walk-forward folds: train up to a cut, skip an embargo, test one span.

Only fold bounds live on the driver (one row per span of history).  Rows learn
their fold from a literal array of edges, map-side, without a join.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.operators.guards import DataGuardError

DEFAULT_EMBARGO = dt.timedelta(days=7)


def step_months(moment: dt.datetime, months: int) -> dt.datetime:
    """Calendar step that clips to the month's last day (and, repeated, stays clipped)."""
    index = moment.year * 12 + moment.month - 1 + months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return moment.replace(year=year, month=month + 1, day=min(moment.day, last))


@dataclass(frozen=True)
class FoldPlan:
    """Walk-forward parameters; the span is in months or in days."""

    initial_train_end: dt.datetime
    span_months: int = 0
    span_days: int = 0
    embargo: dt.timedelta = DEFAULT_EMBARGO
    max_folds: int | None = None

    def __post_init__(self) -> None:
        if self.embargo < dt.timedelta(0):
            raise DataGuardError("embargo must be non-negative")
        if self.max_folds is not None and self.max_folds < 1:
            raise DataGuardError("max_folds must be at least 1")
        if self.span_months <= 0 and self.span_days <= 0:
            raise DataGuardError("the test span must be positive")
        if self.initial_train_end.tzinfo is not None:
            raise DataGuardError("give the first cut as a naive UTC datetime, like the time column")

    def next_cut(self, cut: dt.datetime) -> dt.datetime:
        return step_months(cut, self.span_months) + dt.timedelta(days=self.span_days)

    def candidates(self, last: dt.datetime) -> list[tuple[dt.datetime, dt.datetime, dt.datetime]]:
        """(cut, test start, test end) until a window opens after the last row.

        A window ends where the next begins, so unequal months never overlap.
        """
        found, cut = [], self.initial_train_end
        while cut + self.embargo <= last:
            following = self.next_cut(cut)
            found.append((cut, cut + self.embargo, following + self.embargo))
            cut = following
        return found


@dataclass(frozen=True)
class Fold:
    fold: int
    candidate: int
    cut: dt.datetime
    test_start: dt.datetime
    test_end: dt.datetime
    train_rows: int
    test_rows: int
    train_start: dt.datetime
    train_end: dt.datetime


@dataclass(frozen=True)
class FoldTable:
    """Folds that have both training and test rows, numbered in time order."""

    folds: list[Fold]
    cuts: list[dt.datetime] = field(default_factory=list)
    first_time: dt.datetime | None = None

    def __len__(self) -> int:
        return len(self.folds)

    def as_rows(self, spark) -> DataFrame:
        """The table as a DataFrame (literal rows, one per fold)."""
        stamp = T.TimestampNTZType()
        schema = T.StructType([
            T.StructField("fold", T.IntegerType()),
            T.StructField("train_rows", T.LongType()),
            T.StructField("train_start", stamp),
            T.StructField("train_end", stamp),
            T.StructField("cut", stamp),
            T.StructField("embargo_end", stamp),
            T.StructField("test_start", stamp),
            T.StructField("test_end", stamp),
            T.StructField("test_rows", T.LongType()),
        ])
        return spark.createDataFrame(
            [(f.fold, f.train_rows, f.train_start, f.train_end, f.cut, f.test_start, f.test_start, f.test_end,
              f.test_rows) for f in self.folds],
            schema,
        )


def _stamp(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def edge_count(time: Column, edges: Sequence[dt.datetime], *, inclusive: bool) -> Column:
    """How many sorted edges lie at or before (``inclusive``) or strictly before ``time``.

    A balanced tree of comparisons: log2(edges) of them per row, inside code generation.
    """
    stamp = time.cast("timestamp_ntz")

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        edge = _stamp(edges[middle])
        passed = (edge <= stamp) if inclusive else (edge < stamp)
        return F.when(passed, search(middle + 1, hi)).otherwise(search(lo, middle))

    return F.when(stamp.isNotNull(), search(0, len(edges)))


def train_bucket(time: Column, cuts: Sequence[dt.datetime]) -> Column:
    """Index of the first cut at or after ``time``: the first fold that trains on the row."""
    return edge_count(time, cuts, inclusive=False)


def build_folds(df: DataFrame, time: str, plan: FoldPlan) -> FoldTable:
    """Bounds and row counts of every fold.

    Two small aggregates reach the driver: the time range, and counts per pair of
    (first training fold, test window).
    """
    stamp = F.col(time).cast("timestamp_ntz")
    span = df.agg(F.min(stamp).alias("lo"), F.max(stamp).alias("hi")).first()
    if span["lo"] is None:
        raise DataGuardError("cannot split an empty table")
    windows = plan.candidates(span["hi"])
    if not windows:
        return FoldTable([], [], span["lo"])
    cuts = [w[0] for w in windows]
    starts = [w[1] for w in windows] + [windows[-1][2]]
    cells = (
        df.filter(F.col(time).isNotNull())
        .groupBy(train_bucket(F.col(time), cuts).alias("b"), edge_count(stamp, starts, inclusive=True).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(stamp).alias("hi"))
        .collect()
    )
    folds: list[Fold] = []
    for k, (cut, start, end) in enumerate(windows):
        if plan.max_folds is not None and len(folds) >= plan.max_folds:
            break
        train = [c for c in cells if c["b"] <= k]
        test_rows = sum(c["n"] for c in cells if c["w"] == k + 1)
        if not train or not test_rows:
            continue
        folds.append(Fold(len(folds), k, cut, start, end, sum(c["n"] for c in train), test_rows,
                          span["lo"], max(c["hi"] for c in train)))
    return FoldTable(folds, [f.cut for f in folds], span["lo"])


def test_fold(time: Column, table: FoldTable) -> Column:
    """Fold whose test window holds the row, NULL outside every window."""
    stamp = time.cast("timestamp_ntz")
    if not table.folds:
        return F.lit(None).cast("int")
    opened = edge_count(stamp, [f.test_start for f in table.folds], inclusive=True)
    closes = F.array(*[_stamp(f.test_end) for f in table.folds])
    inside = (opened > 0) & (stamp < F.get(closes, opened - 1))
    return F.when(inside, (opened - 1).cast("int"))


def assign_folds(df: DataFrame, time: str, table: FoldTable, *, output: str = "fold") -> DataFrame:
    return df.withColumn(output, test_fold(F.col(time), table))


def with_fitted(audit: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Audit rows plus the number of groups fitted in each fold."""
    fitted = coefficients.groupBy("fold").agg(F.count(F.lit(1)).alias("groups_fitted"))
    return audit.join(fitted, "fold", "left").withColumn(
        "groups_fitted", F.coalesce(F.col("groups_fitted"), F.lit(0))
    )


def limited(plan: FoldPlan, max_folds: int) -> FoldPlan:
    return replace(plan, max_folds=max_folds)
