"""Per-group calendar regressions, refitted walk-forward from running sums.

One pass over the panel adds up every group's cross products per training bucket;
a running sum over buckets is then the normal matrix of every expanding fold.
Only the k x k solves run in Python, a batch of (fold, group) rows at a time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.timecal import calendar_terms
from pitpanel.operators.folds import FoldPlan, FoldTable, build_folds, test_fold, train_bucket, with_fitted
from pitpanel.operators.guards import require_columns


@dataclass(frozen=True)
class CalendarModel:
    """``target ~ 1 + regressor + calendar`` per group.

    ``fit_on`` and ``serve`` may be different columns of the same quantity: fit on
    the realised one, serve the forecast one; an oracle serves the realised one.
    ``min_rows`` is 10 for per-period and 30 for per-zone models.
    """

    target: str
    fit_on: str
    serve: str
    group: Sequence[str]
    time: str
    day: str
    holiday: str | None = "is_holiday_any"
    year_end: str | None = "is_christmas_period"
    calendar: bool = True
    harmonics: int = 2
    ridge: float = 1e-6
    min_rows: int = 30

    def terms(self, regressor: str, origin: dt.date) -> list[tuple[str, Column]]:
        """Design columns; the waves come last, so fewer waves is a leading sub-matrix."""
        found = [("intercept", F.lit(1.0)), ("regressor", F.col(regressor).cast("double"))]
        if not self.calendar:
            return found
        calendar = calendar_terms(self.day, origin, harmonics=self.harmonics)
        found += calendar[:6]
        found += [(name, F.col(c).cast("double")) for name, c in
                  (("is_holiday", self.holiday), ("is_christmas_period", self.year_end)) if c]
        return found + calendar[6:]

    @property
    def size(self) -> int:
        if not self.calendar:
            return 2
        return 9 + bool(self.holiday) + bool(self.year_end) + 2 * self.harmonics


def running_sums(df: DataFrame, model: CalendarModel, table: FoldTable) -> DataFrame:
    """Per (group, fold): rows, upper triangle of X'X and X'y over the fold's training rows.

    Rows without target or regressor are left out; the trend starts at the panel's
    first day, which every expanding training set shares.
    """
    group = list(model.group)
    require_columns(df, [*group, model.target, model.fit_on, model.time, model.day])
    if not table.folds:
        raise ValueError("no fold has both training and test rows")
    origin = table.first_time.date()
    names = [f"_x{i}" for i in range(model.size)]
    design = [expr.alias(n) for n, (_, expr) in zip(names, model.terms(model.fit_on, origin))]
    bucket = train_bucket(F.col(model.time), table.cuts)
    rows = (
        df.filter(F.col(model.target).isNotNull() & F.col(model.fit_on).isNotNull() & F.col(model.time).isNotNull())
        .select(*group, bucket.alias("_b"), F.col(model.target).cast("double").alias("_y"), *design)
        .filter(F.col("_b") < len(table))
    )
    pairs = [(i, j) for i in range(model.size) for j in range(i, model.size)]
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_g_{i}_{j}") for i, j in pairs]
    sums += [F.sum(F.col(n) * F.col("_y")).alias(f"_r_{i}") for i, n in enumerate(names)]
    cells = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"), *sums)

    # A group's running total holds until its next bucket with rows.
    by_group = Window.partitionBy(*group).orderBy("_b")
    so_far = by_group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gram = F.array(*[F.sum(f"_g_{i}_{j}").over(so_far) for i, j in pairs])
    moment = F.array(*[F.sum(f"_r_{i}").over(so_far) for i in range(model.size)])
    until = F.coalesce(F.lead("_b").over(by_group), F.lit(len(table)))
    running = cells.select(
        *group, "_b", until.alias("_until"), F.sum("_n").over(so_far).alias("n"), gram.alias("gram"), moment.alias("moment")
    )
    return running.select(
        *group, F.explode(F.sequence(F.col("_b"), F.col("_until") - 1)).alias("fold"), "n", "gram", "moment"
    )


@dataclass(frozen=True)
class Variant:
    """One solution read off shared sums: fewer waves use a leading sub-matrix."""

    column: str
    size: int
    ridge: float
    min_rows: int


def _solver(k_full: int, variants: Sequence[Variant]):
    upper = np.triu_indices(k_full)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns=["gram", "moment"])
            grams = np.zeros((len(pdf), k_full, k_full))
            if len(pdf):
                grams[:, upper[0], upper[1]] = np.stack(pdf["gram"].to_numpy())
            for v in variants:
                penalty = v.ridge * np.eye(v.size)
                penalty[0, 0] = 0.0  # the intercept is never shrunk
                solved: list = []
                for gram, moment, n in zip(grams, pdf["moment"], pdf["n"]):
                    if n < v.min_rows:
                        solved.append(None)
                        continue
                    square = gram[: v.size, : v.size]
                    square = square + np.triu(square, 1).T + penalty
                    solved.append(np.linalg.lstsq(square, np.asarray(moment)[: v.size], rcond=None)[0].tolist())
                out[v.column] = pd.Series(solved, index=out.index, dtype=object)
            yield out

    return solve


def solve_variants(sums: DataFrame, model: CalendarModel, variants: Sequence[Variant]) -> DataFrame:
    """Ridge solutions per (group, fold), one array column per variant, in one Python pass.

    Groups below a variant's ``min_rows`` get no model.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields
                       if f.name not in ("gram", "moment"))
    arrays = ", ".join(f"`{v.column}` array<double>" for v in variants)
    return sums.filter(F.col("n") >= min(v.min_rows for v in variants)).mapInPandas(
        _solver(model.size, variants), schema=f"{fields}, {arrays}"
    )


def solve_coefficients(sums: DataFrame, model: CalendarModel, *, harmonics: int | None = None) -> DataFrame:
    used = replace(model, harmonics=model.harmonics if harmonics is None else harmonics)
    return solve_variants(sums, model, [Variant("coefficients", used.size, model.ridge, model.min_rows)])


def predict(df: DataFrame, coefficients: DataFrame, table: FoldTable, outputs: Mapping[str, tuple[CalendarModel, str]]) -> DataFrame:
    """Out-of-sample predictions; ``outputs`` maps a new column to (model, coefficient column).

    NULL outside test windows, without a model, or without input: never another group's
    or fold's model.  One join serves all outputs.
    """
    group = list(next(iter(outputs.values()))[0].group)
    time = next(iter(outputs.values()))[0].time
    columns = list(dict.fromkeys(c for _, c in outputs.values()))
    named = coefficients.select(*[F.col(g).alias(f"_k_{g}") for g in group], F.col("fold").alias("_k_fold"),
                                *[F.col(c).alias(f"_beta_{c}") for c in columns])
    on = F.col("_fold") == F.col("_k_fold")
    for g in group:
        on = on & (F.col(g) == F.col(f"_k_{g}"))
    fitted = {}
    for output, (model, column) in outputs.items():
        # An array dot product keeps the generated code small enough to be compiled.
        row = F.array(*[expr for _, expr in model.terms(model.serve, table.first_time.date())])
        products = F.zip_with(row, F.col(f"_beta_{column}"), lambda x, b: x * b)
        fitted[output] = F.aggregate(products, F.lit(0.0), lambda total, p: total + p)
    return (
        df.withColumn("_fold", test_fold(F.col(time), table))
        .join(named, on, "left")
        .select(*df.columns, *[expr.alias(name) for name, expr in fitted.items()])
    )


def _sums_key(model: CalendarModel) -> tuple:
    return model.target, model.fit_on, tuple(model.group), model.holiday, model.year_end, model.calendar


def walk_forward(df: DataFrame, models: Mapping[str, CalendarModel], plan: FoldPlan | FoldTable, *,
                 time: str | None = None) -> tuple[DataFrame, FoldTable, DataFrame]:
    """Predict with several specifications: ``models`` maps output column to model.

    Specifications that share target, regressor and groups share one pass over the
    panel, one solve and one join; those with fewer waves or another served column
    differ only in what they read off it.  The panel is read once for the folds, once
    per pass and once to predict, so store an expensive one first.
    Returns the panel with predictions, the folds, and the audit of the first model.
    """
    first = next(iter(models.values()))
    table = plan if isinstance(plan, FoldTable) else build_folds(df, time or first.time, plan)
    families: dict[tuple, dict[str, CalendarModel]] = {}
    for output, model in models.items():
        families.setdefault(_sums_key(model), {})[output] = model
    out, audit = df, None
    for family in families.values():
        widest = max(family.values(), key=lambda m: m.harmonics)
        variants = {
            output: Variant(f"beta_{m.harmonics}_{m.ridge!r}_{m.min_rows}".replace(".", "_").replace("-", "m"), m.size, m.ridge, m.min_rows)
            for output, m in family.items()
        }
        solved = solve_variants(running_sums(df, widest, table), widest, list(dict.fromkeys(variants.values())))
        out = predict(out, solved, table, {o: (m, variants[o].column) for o, m in family.items()})
        if audit is None:
            fitted = solved.filter(F.col(next(iter(variants.values())).column).isNotNull())
            audit = with_fitted(table.as_rows(df.sparkSession), fitted)
    return out, table, audit
