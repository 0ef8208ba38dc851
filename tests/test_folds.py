import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import folds as fo
from pitpanel.operators.guards import DataGuardError

FIRST = dt.datetime(2023, 6, 30)
PLAN = fo.FoldPlan(initial_train_end=FIRST, span_months=1)


@pytest.fixture(scope="module")
def half_hours(spark):
    start = "timestamp_ntz'2023-01-01 00:00:00'"
    return spark.sql(f"select explode(sequence({start}, {start} + interval 399 days 23 hours 30 minutes, interval 30 minutes)) t").cache()


def test_train_before_embargo_before_test(half_hours):
    table = fo.build_folds(half_hours, "t", PLAN)
    assert len(table) == 7
    for f in table.folds:
        assert f.train_end <= f.cut and f.test_start - f.cut == dt.timedelta(days=7)
        assert f.train_end < f.test_start
    for a, b in zip(table.folds, table.folds[1:]):
        assert a.test_end == b.test_start and a.train_rows < b.train_rows


def test_assignment_counts_match_the_table_and_are_disjoint(half_hours):
    table = fo.build_folds(half_hours, "t", PLAN)
    counts = fo.assign_folds(half_hours, "t", table).dropna().groupBy("fold").count().collect()
    assert {r["fold"]: r["count"] for r in counts} == {f.fold: f.test_rows for f in table.folds}


def test_row_order_does_not_matter(half_hours):
    assert fo.build_folds(half_hours.orderBy(F.rand(3)), "t", PLAN) == fo.build_folds(half_hours, "t", PLAN)


def test_max_folds_and_short_history(spark, half_hours):
    assert len(fo.build_folds(half_hours, "t", fo.limited(PLAN, 2))) == 2
    short = half_hours.filter("t < timestamp_ntz'2023-01-11'")
    assert len(fo.build_folds(short, "t", PLAN)) == 0
    assert fo.assign_folds(short, "t", fo.build_folds(short, "t", PLAN)).dropna().count() == 0


def test_empty_windows_are_skipped_and_not_numbered(half_hours):
    gap = half_hours.filter("t < timestamp_ntz'2023-08-01' or t >= timestamp_ntz'2023-11-01'")
    table = fo.build_folds(gap, "t", PLAN)
    assert [f.fold for f in table.folds] == list(range(len(table)))
    assert [f.candidate for f in table.folds] == [0, 3, 4, 5, 6]
    got = fo.assign_folds(gap, "t", table).dropna().groupBy("fold").count().collect()
    assert {r["fold"]: r["count"] for r in got} == {f.fold: f.test_rows for f in table.folds}


def test_bad_parameters(spark):
    with pytest.raises(DataGuardError):
        fo.FoldPlan(initial_train_end=FIRST, span_months=1, embargo=dt.timedelta(days=-1))
    with pytest.raises(DataGuardError):
        fo.FoldPlan(initial_train_end=FIRST, span_months=1, max_folds=0)
    with pytest.raises(DataGuardError):
        fo.FoldPlan(initial_train_end=FIRST.replace(tzinfo=dt.timezone.utc), span_months=1)
    with pytest.raises(DataGuardError, match="empty"):
        fo.build_folds(spark.createDataFrame([], "t timestamp_ntz"), "t", PLAN)


def test_month_steps_clip_and_stay_clipped():
    step = fo.step_months(dt.datetime(2024, 1, 31), 1)
    assert step == dt.datetime(2024, 2, 29) and fo.step_months(step, 1) == dt.datetime(2024, 3, 29)


def test_a_supplier_of_the_panel_lies_in_one_file(spark, tmp_path):
    from pitpanel.catalog import walkforward

    (spark.range(4000).selectExpr("id % 20 AS l_suppkey", "date_add(DATE '1996-01-01', CAST(id % 400 AS INT)) AS l_shipdate", "1.0D AS l_quantity",
                                  "2.0D AS l_extendedprice", "0.1D AS l_discount").write.parquet(f"{tmp_path}/lineitem.parquet"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        panel = walkforward.shipments(spark, str(tmp_path))
    finally:
        spark.conf.set(name, before)
    files = panel.select("l_suppkey", F.input_file_name().alias("file")).distinct().groupBy("l_suppkey").count().collect()
    assert len(files) == 20 and {r["count"] for r in files} == {1}
